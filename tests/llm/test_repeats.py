"""Substring dedup by recompression against brute force and its SQL."""

import hashlib
import random

import numpy as np
import pytest

from sievemark.llm import repeats
from sievemark.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, window=13):
    words = [(1 << 63) - 1 if d is None else d for d, _ in rows], [(t or "").encode().split() for _, t in rows]
    least = {}
    for d, w in zip(*words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = []
    for (doc_id, _), d, w in zip(rows, *words):
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(doc_id), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def held(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def planted(seed, docs=60, words=400):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(words)}" for _ in range(n)]
    passages = [text(rng.choice([12, 13, 14, 30, 55, 120])) for _ in range(8)] + [["ha"] * 40, ["a", "b"] * 20]
    rows = []
    for d in range(docs):
        t = text(rng.randrange(0, 90))
        for p in rng.sample(passages, rng.randrange(0, 4)):
            cut = rng.randrange(0, 3)
            at = rng.randrange(len(t) + 1)
            t[at:at] = p[cut:]
        rows.append((d, " \n"[d % 2].join(t)))
    rows += [(1000 + k, rows[k * 3][1]) for k in range(8)] + [(3, rows[5][1]), (3, rows[5][1]), (None, rows[7][1]), (None, None)]
    rng.shuffle(rows)
    return rows


def test_query_equals_sql(same):
    same(QUERIES["op11_substring_dedup"], ORACLE_SQL["op11_substring_dedup"])


def test_odd_rows(odd, none):
    assert held(repeats.remove_repeats(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("window", [13, 30])
def test_planted_passages(spark, window):
    rows = planted(11)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = repeats.remove_repeats(d, window=window, texts=True)
    assert held(got) == brute(rows, window)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_few_different_words(spark):
    rows = [(d, " ".join(random.Random(d).choice("ab") for _ in range(120))) for d in range(30)] + [(99, "a " * 200), (98, "a " * 20)]
    assert held(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("window,rounds", [(13, 1), (13, 3), (40, 4), (1, 2)])
def test_equal_windows_are_known_by_equal_symbols(window, rounds):
    rng = np.random.default_rng(window)
    shared = rng.integers(0, 5, 3 * window).astype(np.uint64)
    seqs = [np.concatenate((rng.integers(0, 5, rng.integers(0, 30)), shared, rng.integers(0, 5, rng.integers(0, 30)))).astype(np.uint64) for _ in range(40)]
    known = {}
    for s in seqs:
        for i, k in enumerate(repeats.known_by(s, window, rounds)):
            assert known.setdefault(tuple(s[i : i + window]), k) == k


def test_contexts_rise_and_hold_their_words():
    s = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    for level, (names, x, y) in enumerate(repeats.recompress(s, 5)):
        assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and (x < y).all() and len(names) == len(x) == len(y)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = planted(5, docs=25)
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = repeats._blocks
    monkeypatch.setattr(repeats, "_blocks", lambda batches, repeated, window: blocks(batches, repeated, window, 50))
    assert held(repeats.remove_repeats(d)) == brute(rows)
