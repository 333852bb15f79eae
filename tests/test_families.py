"""Vague phrases, composites without a family, and discovery of files, on cases made by hand."""

from pyspark.sql import functions as F

from sievemark.operators import families as fa
from sievemark.plans import family_queries as fq
from sievemark.sources.discovery import discover


def test_vague_phrases(spark):
    d = spark.createDataFrame([*enumerate(fq.TEXTS), (98, None), (99, "")], "k int, text string")
    got = {r.k: r for r in fa.flat_substance(d.withColumn("substance", F.lit(40))).collect()}
    assert [v.phrase for v in got[0].vague] == ["do not have a reproducer", "private fuzzing harness", "may not be encrypted", "modern threat landscape"]
    assert [(got[k].haircut, got[k].flat_substance) for k in (0, 1, 2, 3, 98, 99)] == [(24, 16), (6, 34), (18, 7), (6, 34), (0, 40), (0, 40)]
    own = d.select("k", fa.vague_phrases(F.col("text"), [("check the length", "mine")]).alias("v")).where(F.size("v") > 0).collect()
    assert [(r.k, r.v[0].category) for r in own] == [(1, "mine")]


def test_family_composite(spark):
    rows = [
        (50, "FLAT", 18, -5, -8, "", 29, "HIGH RISK"), (50, "FLAT", 12, None, None, "", 50, "NEEDS REVIEW"), (50, "CRYPTO", 24, 7, 0, fq.TEXTS[1], 40, "NEEDS REVIEW"), (3, "FLAT", 24, -5, None, None, 0, "LIKELY INVALID"),
        (90, None, None, None, None, None, 90, "STRONG"),
    ]
    d = spark.createDataFrame(rows, "composite int, family string, haircut int, velocity_penalty int, template_penalty int, text string, expected long, label string")
    for r in fa.family_composite(d).collect():
        assert (r.family_composite, r.family_label) == (r.expected, r.label)


def test_discover(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "b.jsonl").write_text("{}"), (two / "a.json").write_text("{}"), (two / "a.json.gz").write_bytes(b"x"), (one / "a.json").write_bytes(b""), (two / "b.jsonl").write_text("{}")
    got = discover(spark, [str(tmp_path / "none"), str(one), str(two)], {"a": ["a.json.gz", "a.json"], "b": ["b.jsonl"], "c": ["c.parquet"]})
    assert got["a"].endswith("/two/a.json.gz") and got["b"].endswith("/one/b.jsonl") and got["c"] is None
    assert discover(spark, [str(one)], {}) == {}
