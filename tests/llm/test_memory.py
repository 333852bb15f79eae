"""What a task holds of its batches."""

import tracemalloc

import pyarrow as pa
import pytest

from sievemark.llm import common, near_dedup, packing, toxicity
from sievemark.llm.queries import vocabulary


class Taken:
    """Stands for a table and takes the task that it is given."""

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        self.task = task
        return self


def task_of(name):
    if name == "sign":
        return near_dedup.sign(Taken(), "doc_id", "text").task
    if name == "score":
        model = {"lexicon": {}, "base": -3.0, "weights": [0.0] * len(toxicity.KINDS)}
        return toxicity.score(Taken(), model).task
    return packing.pieces(Taken(), vocabulary("word_bpe_49k.json")).task


def batch(n, size):
    words = [f"{k}ccommodation " * (size // 14) for k in "abcdefghijklmnopqrst"]
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array([words[k % 20] for k in range(n)])], ["doc_id", "text"])


@pytest.mark.parametrize("name", ["sign", "score", "pieces"])
def test_a_task_holds_few_texts_as_objects(spark, name):
    task = task_of(name)
    list(task(iter([batch(20, 400)])))  # what a worker keeps anyway
    rows = batch(2400, 16_000)
    tracemalloc.start()
    try:
        made = sum(out.num_rows for out in task(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made >= 2400
    assert peak < 32e6 < rows.nbytes


@pytest.mark.parametrize("name", ["sign", "score", "pieces"])
def test_a_task_gives_back_what_arrow_keeps(spark, name, monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    task = task_of(name)
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    list(task(iter([batch(20, 400)])))
    assert calls == [1]


def test_few_texts_are_all_texts_in_order():
    texts = [None, "", "ü" * 700, *("x" * k for k in range(300)), "y" * 50_000, "z"] * 3
    column = pa.array(texts, pa.string())
    for size in (1, 1000, 1 << 20):
        got = list(common.few_texts(column, size))
        assert [t for some in got for t in some] == texts
        assert all(len(some) == 1 or sum(len(t or "") for t in some) <= 4 * size for some in got)
    assert list(common.few_texts(column.slice(4, 2), 1000)) == [texts[4:6]]
    assert list(common.few_texts(column.slice(0, 0))) == []
