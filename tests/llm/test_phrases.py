"""Phrase mining against brute force and its SQL, and the hash below it."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm import phrases
from sievemark.llm.queries import ORACLE_SQL, QUERIES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        c = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and b >= least and 100 * b >= 50 * a for q, b in c.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def held(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def planted(seed, docs=80):
    rng = random.Random(seed)
    rows = []
    for d in range(docs):
        words = [rng.choice(["new", "York", "city", "of", "the", "Über", "日本", "a'b", "x y", "rare%d" % rng.randrange(500)]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\r\n", "\x0b"]) for w in words)
        rows.append((text + rng.choice(["", " machine learning model", " machine learning. model"]), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" ha" * 30, "x\ty")]


def test_query_equals_sql(same):
    same(QUERIES["op13_collocations"], ORACLE_SQL["op13_collocations"])


def test_planted_phrases(spark):
    rows = planted(3)
    d = spark.createDataFrame([(i, *r, 1, "k") for i, r in enumerate(rows)], "doc_id long, text string, lang string, h long, key string").repartition(5)
    assert held(phrases.collocations(d)) == brute(rows)
    assert held(phrases.collocations(d, top=3)) == brute(rows, top=3)


def test_odd_rows(spark, odd, none):
    assert held(phrases.collocations(odd, least=2)) == brute([(r.text, r.lang) for r in odd.collect()], least=2)
    assert phrases.collocations(none).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 22])
def test_shards_salts_and_blocks_give_the_same(spark, monkeypatch, most):
    rows = planted(9)
    monkeypatch.setattr(phrases, "HELD", most)
    monkeypatch.setattr(phrases, "SLOTS", 40)
    d = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    want = brute(rows)
    monkeypatch.setattr(phrases, "ROWS", 20)
    monkeypatch.setattr(phrases, "FAN_IN", 2)
    count, blocks = phrases.count_phrases, phrases._blocks
    monkeypatch.setattr(phrases, "count_phrases", lambda r, k: count(r, k, 40))
    monkeypatch.setattr(phrases, "_blocks", lambda b, seed, n: blocks(b, seed, 100))
    monkeypatch.setattr(phrases, "MEMO", 50)
    assert held(phrases.collocations(d)) == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 60000])
def test_hash_is_minimal_and_perfect(n):
    h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    m = phrases.Hash.of(h)
    again = phrases.Hash(m.sizes, m.bits)
    assert sorted(m(h)) == list(range(len(h))) and (again(h) == m(h)).all() and m.slots == len(h)


def test_a_stranger_has_no_slot_and_a_twin_has_its_own():
    h = np.array([5, 9, 13], np.uint64)
    m = phrases.Hash.of(h)
    slot = m(h)
    own = np.zeros((3, 4), np.int64)
    own[0, slot], own[1, slot] = [50, 90, 130], [51, 91, 0]
    own[:, 3] = [92, 93, 0]  # has the hash of (90, 91)
    shard = {"sizes": m.sizes, "bits": m.bits, "keys": list(own)}
    asked = [np.array(c) for c in ([90, 92, 94, 50, 1], [91, 93, 0, 51, 2], [0, 0, 0, 0, 0])]
    got = phrases._slots_of(shard, np.array([9, 9, 9, 5, 77], np.int64), asked)
    assert list(got) == [slot[1], 3, -1, slot[0], -1]


def test_words_with_one_hash_get_another_seed(spark, monkeypatch):
    rows = planted(4, 40)
    hashes = phrases.Lexicon.hashes

    def clashing(self):
        out = hashes(self)
        return np.where(np.isin(self.keys, [b"en\tyork", b"en\tcity"]), np.uint64(7), out) if self.seed == 0 else out

    monkeypatch.setattr(phrases.Lexicon, "hashes", clashing)
    d = spark.createDataFrame(rows, "text string, lang string")
    assert held(phrases.collocations(d)) == brute(rows)


def test_hash_of_a_name_is_that_of_spark(spark):
    w = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, (3, 50), dtype=np.int64)
    d = spark.createDataFrame([tuple(map(int, r)) for r in w.T], "w1 long, w2 long, w3 long").select("w1", phrases._hash_of(2).alias("two"), phrases._hash_of(3).alias("three"))
    got = {r.w1: (r.two, r.three) for r in d.collect()}
    u = w.view(np.uint64)
    two = phrases._mix(u[0], u[1])
    three = phrases._mix(two, u[2])
    assert got == {int(a): (int(b), int(c)) for a, b, c in zip(w[0], two.view(np.int64), three.view(np.int64))}


def test_distinct_phrases_at_any_number_of_words():
    ids = np.random.default_rng(3).integers(0, 4, 300)
    at = np.arange(290)
    for length in (1, 2, 3):
        seen = [phrases._distinct(ids, at, length, n) for n in (4, 1 << 31)] if length > 1 else [phrases._distinct(ids, at, 1, 4)]
        want = Counter(tuple(ids[i : i + length].tolist()) for i in at)
        for parts, c in seen:
            assert dict(zip(zip(*[p.tolist() for p in parts]), c.tolist())) == want


def test_numbers_are_those_of_a_plain_split():
    rng = random.Random(5)
    for _ in range(300):
        texts = [(bytes(rng.choice(b"abAB \t.,;:!?\n\x0b\x0c\r\x00\x1c\xc3") for _ in range(rng.randrange(1, 30))), rng.choice(["en", "x\ty", ""])) for _ in range(rng.randrange(1, 6))]
        lexicon, want = phrases.Lexicon(0), Counter()
        for text, lang in texts:  # a part each
            lexicon.add([text], lang)
            for piece in re.split(b"[.,;:!?\n\x0b\x0c\r]", text.lower()):
                w = [lang.encode() + b"\t" + x for x in re.findall(b"[^ \t]+", piece)]
                want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        ids = lexicon.numbers()
        assert ids[-1] == -1 and len(set(lexicon.keys)) == len(lexicon.keys)
        runs = [tuple(ids[i : i + k].tolist()) for k in (1, 2, 3) for i in range(len(ids) - k + 1)]
        assert Counter(tuple(lexicon.keys[i] for i in r) for r in runs if min(r) >= 0) == want


def test_texts_are_read_by_tasks_that_split_them_only_and_each_length_has_a_sieve(spark, monkeypatch):
    sieves, was = [], phrases.Held.__init__
    monkeypatch.setattr(phrases.Held, "__init__", lambda self, keys, texts, seed, s: (sieves.extend(s), was(self, keys, texts, seed, s))[1])
    rows = planted(6)
    d = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and len(sieves) == phrases.LONGEST
    assert held(d) == brute(rows)


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_combined_counts_are_those_of_all_blocks(most):
    rng = np.random.default_rng(8)
    blocks = [([rng.integers(0, 6, 40), rng.integers(0, 3, 40), np.zeros(40, np.int64)], rng.integers(1, 9, 40)) for _ in range(6)] + [([np.empty(0, np.int64)] * 3, np.empty(0, np.int64))]
    want, got, rows = Counter(), Counter(), 0
    for name, c in blocks:
        for *k, n in zip(*map(np.ndarray.tolist, name), c.tolist()):
            want[tuple(k)] += n
    for name, c in phrases._combined(iter(blocks), most):
        rows += len(c)
        for *k, n in zip(*map(np.ndarray.tolist, name), c.tolist()):
            got[tuple(k)] += n
    assert got == want and (most < 10**6 or rows == len(want))


def test_routed_rows_hold_names_and_counts_of_a_task(spark, monkeypatch):
    """Beyond HELD the local counts of a task's blocks are one row a phrase, and no hash travels with them."""
    seen, was = [], phrases._routed
    monkeypatch.setattr(phrases, "HELD", 0)
    monkeypatch.setattr(phrases, "_routed", lambda rows, *a: (seen.append(rows), was(rows, *a))[1])
    blocks = phrases._blocks
    monkeypatch.setattr(phrases, "_blocks", lambda b, seed, n: blocks(b, seed, 100))
    rows = planted(7)
    got = held(phrases.collocations(spark.createDataFrame(rows, "text string, lang string").coalesce(1)))
    assert got == brute(rows)
    assert seen[0].columns == [*phrases.NAME, "c"] and seen[0].count() == seen[0].select(*phrases.NAME).distinct().count()
