"""Pre-filters, fabrication checks and relational helpers on small cases."""

from pyspark.sql import functions as F

from sievemark.operators import detectors as de
from sievemark.operators import monitoring as mo
from sievemark.operators import relational as rl


def test_prefilter(spark):
    rows = [(1, "Pay $500 in btc or we will publish everything."), (2, "please whitelist us"), (3, "see CVE-20-1234 and CVE-2020-0001"), (4, None), (5, "Minimum bounty of $500. Rate card attached.")]
    d = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in de.prefilter(d, rejected=spark.createDataFrame([("CVE-2020-0001",)], "id string")).collect()}
    assert got[1].quarantined and got[1].route == "legal_ir_soc" and got[1].realness_cap == 0.0
    assert not got[2].quarantined and got[2].total_severity == 2 and got[2].route is None
    assert sorted(f.flag for f in got[3].fires) == ["hallucinated_cve_format", "rejected_cve"] and got[3].route == "psirt_triage" and got[3].realness_cap == 0.2
    assert got[4].total_severity == 0 and got[4].fires == []
    assert got[5].total_severity == 4 and got[5].route == "psirt_triage"


def test_cve_checks(spark):
    d = spark.createDataFrame([("CVE-1998-1111 CVE-2031-1234",), ("CVE-2020-1000 CVE-2020-2000 CVE-2020-3 CVE-2020-123456789",), ("CVE-2019-1001 CVE-2019-1002 CVE-2019-1003",), ("",)], "t string")
    assert [tuple(r) for r in d.select(de.cve_years(F.col("t"), 2026), de.fabricated_cves(F.col("t"), 2026)).collect()] == [(35, 0), (0, 18), (0, 5), (0, 0)]


def test_log_score(spark):
    d = spark.createDataFrame([(0,), (15,), (1000000,)], "w long")
    assert [r[0] for r in d.select(de.log_score(F.col("w"))).collect()] == [0, 83, 100]


def test_severity(spark):
    d = spark.createDataFrame([("critical severity",), ("critical severity, see exec(x)",), ("CVSS: 12.0",)], "t string")
    assert [r[0] for r in d.select(de.severity_inflation(F.col("t"))).collect()] == [15, 0, 10]


def test_feed_and_codes(spark):
    d = spark.createDataFrame([(i, i % 3, i) for i in range(10)], "id long, score long, created_at long")
    page = rl.feed(d, "id", "highest", 2, 3).orderBy("place").collect()
    assert [(r.id, r.place, r.more) for r in page] == [(2, 3, True), (7, 4, True), (4, 5, True)]
    assert [r[0] for r in spark.createDataFrame([(1,), (70000,)], "i long").select(rl.code(F.col("i"))).collect()] == ["VR-0001", "VR-11170"]
    assert rl.where_all(d, {"score": 1, "id": None}, {"id": (2, 5)}).count() == 1


def test_nearest_within(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "k", t), (2, "k", t + timedelta(seconds=300))], "id long, key string, ts timestamp")
    b = spark.createDataFrame([(7, "k", t - timedelta(seconds=60)), (8, "k", t + timedelta(seconds=60)), (9, "k", t + timedelta(seconds=239))], "rid long, key string, ts timestamp")
    assert {r.id: (r.rid, r.gap_s) for r in mo.nearest_within(a, b, "key", "ts", 60).collect()} == {1: (7, 60.0)}


def test_closure(spark):
    e = spark.createDataFrame([(3, 2), (2, 1), (3, 1), (1, 0)], "cwe long, parent long")
    assert {(r.cwe, r.ancestor): r.distance for r in de.cwe_closure(e).collect()} == {(3, 2): 1, (3, 1): 1, (3, 0): 2, (2, 1): 1, (2, 0): 2, (1, 0): 1}
