"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from llm_help import DATA
from test_dedup import shingle_set
from test_pack_mix import check_packing

from sievemark.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, as the pipeline hands them on."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, f in cp.STAGES:
        path = f"file://{folder}/{name}"
        f(spark, docs, DATA).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return dict(zip([n for n, _ in cp.STAGES], out))


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, (before, made) in stages.items():
        if name != "packing":
            assert sorted(made.columns) == sorted(before.columns)


def test_toxicity_stage(spark, stages):
    before, made = stages["toxicity"]
    m = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = Counter(r.doc_id for r in toxicity.score(before, m).where("predicted = 0").collect())
    assert ids(made) == want
    clean = [r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()]
    assert sum(d in want for d in clean) >= 0.98 * len(clean)


def test_exact_stage(stages):
    before, made = stages["exact_dedup"]
    top = {}
    for r in before.collect():
        top[r.text] = max(top.get(r.text, -1), r.doc_id)
    assert sorted(ids(made)) == sorted(top.values())


def test_near_stage(stages):
    before, made = stages["near_dedup"]
    rows = [(r.doc_id, shingle_set(r.text)) for r in before.collect()]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(ids(made)) == sorted({find(d) for d, _ in rows})


def test_mixing_and_packing_stages(stages):
    before, made = stages["mixing"]
    assert set(ids(made)) <= set(ids(before)) and max(ids(made).values()) <= 2
    assert made.where("n_chars <> length(text)").count() == 0
    mixed, packed = stages["packing"]
    rows = packed.collect()
    check_packing(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == ids(mixed)
