"""Readers and writers."""

import gzip
import json

from pyspark.sql import functions as F

from sievemark.sources import readers as rd
from sievemark.sources import writers as wr


def test_texts_and_binaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.md").write_text("# x")
    (tmp_path / "c.exe").write_bytes(b"\0" * 50)
    assert sorted(r.text for r in rd.read_texts(spark, str(tmp_path)).collect()) == ["# x", "héllo"]
    assert {r.path.rsplit("/")[-1]: r.is_binary for r in rd.read_binaries(spark, str(tmp_path)).collect()} == {"a.txt": False, "b.md": False, "c.exe": True}


def test_json(spark, tmp_path):
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write(json.dumps({"body": "b" * 60, "label": "ai"}) + "\n{broken\n" + json.dumps({"text": "short"}) + "\n" + json.dumps({"text": " ", "content": "c" * 50}) + "\n")
    assert sorted((r.text[0], len(r.text), r.label) for r in rd.read_curated(spark, str(tmp_path / "x.json.gz")).collect()) == [("b", 60, "ai"), ("c", 50, None)]
    assert rd.read_json_lines(spark, str(tmp_path / "x.json.gz"), "body string, text string").count() >= 3
    (tmp_path / "feed.json").write_text(json.dumps({"cves": ["cve-1", "CVE-1", "CVE-2"]}))
    assert sorted(r.id for r in rd.read_id_feed(spark, str(tmp_path / "feed.json"), "cves").collect()) == ["CVE-1", "CVE-2"]


def test_writers(spark, tmp_path):
    p = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    old.write.parquet(p)
    wr.insert_absent(spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k long, v string"), p, ["k"])
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    new = wr.update(old, spark.createDataFrame([(1, "z"), (2, "y")], "k long, v string"), "k", ["v"], F.col("v") != "b")
    assert sorted(map(tuple, new.collect())) == [(1, "z"), (2, "b")]
    assert {r.key: r.value for r in wr.counters(old, {"all": F.lit(True), "a": F.col("v") == "a"}).collect()} == {"all": 2, "a": 1}
    d = spark.createDataFrame([("2024-01-01 10:00:00", 1), ("2024-01-02 10:00:00", 2)], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    wr.write_partitioned(d, str(tmp_path / "days"), "ts")
    wr.replace_days(d.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "days"), "ts")
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 9]


def test_rules_and_scrub(spark, tmp_path):
    from sievemark.operators import relational
    from sievemark.sources import readers

    path = tmp_path / "rules.json"
    path.write_text('[{"phrase": "it is worth noting", "category": "filler"}, {"phrase": "  ", "category": "none"}, {"phrase": "ü", "category": null}]')
    got = readers.read_rules(spark, str(path))
    assert got.columns == ["phrase", "category"] and sorted((r.phrase, r.category) for r in got.collect()) == [("it is worth noting", "filler"), ("ü", None)]
    d = spark.createDataFrame([(1, "secret", "open")], "id int, token string, title string")
    assert relational.scrub(d, ["title", "id", "absent"]).collect() == [("open", 1)]
    assert relational.scrub(d.limit(0), ["id"]).columns == ["id"]
