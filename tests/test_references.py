"""References looked up in tables: hand-made expectations, a reference that many texts share, and the query against its SQL."""

import time

import pytest
from pyspark.sql import functions as F

from sievemark.operators import references as rf
from sievemark.operators import triage
from sievemark.plans.all import QUERIES, SQL

REPO = "https://github.com/acme/tool has"
SAID = "an attacker reading memory through crafted packets sent twice"
CASES = [
    ("nothing here", None),
    ("src/a.c without a repository", None),
    (f"{REPO} src/a.c", ["file_verified"]),
    (f"{REPO} src/b.c and the function parse_all()", ["file_missing", "function_verified"]),
    ("CVE-2020-1111, CVE-2020-1111 and CVE-1998-0001", ["verified_cve", "invalid_cve_year"]),
    (f"CVE-2020-1111: {SAID}", ["plagiarism"]),
    ("CVE-2020-9999 CVE-2024-9999 CVE-2026-9999 CVE-2021-9999", ["fabricated_cve", "stale_missing_cve", "recent_cve_not_yet_published"]),  # three at most
    ("CVE-2028-0001", ["invalid_cve_year"]),
    (None, None),
]


def tables(spark):
    files = spark.createDataFrame([("acme/tool", "src/a.c"), ("acme/tool", "src/a.c"), ("other/tool", "src/b.c")], "repo string, target string")
    functions = spark.createDataFrame([("acme/tool", "parse_all")], "repo string, target string")
    return files, functions, spark.createDataFrame([("CVE-2020-1111", SAID), ("CVE-2020-1111", None)], "target string, description string")


def test_hand_made_references(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    got = {r.doc_id: [c.type for c in r.checks] for r in rf.verify(d, *tables(spark), 2026).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_one_reference_in_very_many_texts(spark, monkeypatch):
    monkeypatch.setattr(rf, "HEAVY_SHARE", 1e-9)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, f"{REPO} src/a.c").otherwise(F.concat(F.lit("CVE-2020-1111 CVE-2019-"), (10000 + F.col("id")).cast("string"))).alias("text"))
    got = rf.verify(d, *tables(spark), 2026).select(F.explode("checks").alias("c")).groupBy("c.type").count().collect()
    assert {r["type"]: r["count"] for r in got} == {"file_verified": 1000, "verified_cve": 2000, "fabricated_cve": 2000}


def test_weights_make_a_score(spark):
    d = spark.createDataFrame([(1, f"{REPO} src/a.c and the function parse_all(), CVE-2020-1111"), (2, "CVE-2020-9999 CVE-1990-1234")], "doc_id int, text string")
    got = {r.doc_id: r.s for r in rf.verify(d, *tables(spark), 2026).select("doc_id", triage.verification(F.col("checks")).alias("s")).collect()}
    assert got == {1: 0, 2: 95}


@pytest.mark.parametrize("name", ["verified_references"])
def test_queries_equal_their_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_a_long_text_is_split_once(spark):
    """Phrases of a text of 30,000 words against a description: a matter of seconds, not of words times words."""
    long = " ".join(f"word{i}" for i in range(30000)) + " " + SAID
    d = spark.createDataFrame([(long, SAID), (long, None), ("short", SAID), (None, SAID)], "t string, d string")
    start = time.monotonic()
    assert [r.o for r in d.select(rf.overlap(F.col("t"), F.col("d")).alias("o")).collect()] == [100, 0, 0, 0]
    assert time.monotonic() - start < 20
