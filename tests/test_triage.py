"""Vulnerability classes, second opinions, checks, schedulers and look-ups on cases made by hand."""

from pyspark.sql import functions as F

from sievemark.operators import monitoring as mo
from sievemark.operators import relational as rl
from sievemark.operators import similarity as si
from sievemark.operators import triage as tr
from sievemark.plans import triage_queries as tq


def test_vuln_class(spark):
    d = spark.createDataFrame([*enumerate(tq.TEXTS), (98, "")], "k int, t string")
    got = {r.k: (r.c.name, r.c.confidence) for r in d.select("k", tr.vuln_class(F.col("t")).alias("c")).collect()}
    names = ["xss", "sqli", "ssrf", "deserialization", "buffer_overflow", "path_traversal", "auth_bypass", "race_condition", "race_condition", "unknown"]
    assert [got[k][0] for k in range(10)] == names and got[98] == ("unknown", 0.0)
    assert got[0][1] == 0.9 and got[6][1] == 0.6


def test_gate(spark):
    rows = [
        (False, 0.1, 40, 40, "skipped_unavailable"), (True, 0.4, 90, 10, "fired_low_confidence"), (True, 0.5, 61, 10, "skipped_above_borderline_composite"), (True, 1.0, 24, 10, "skipped_below_borderline_composite"),
        (True, 1.0, 60, 60, "skipped_composite_borderline_heuristic_confirms_slop"), (True, 1.0, 25, 59, "fired_borderline_composite"), (True, 0.4, None, 25, "fired_borderline_and_low_confidence"),
        (True, 1.0, None, 60, "fired_borderline"), (True, 0.4, None, 90, "fired_low_confidence"), (True, 1.0, None, 61, "skipped_above_borderline"), (True, 1.0, None, 24, "skipped_below_borderline"),
        (True, 1.0, None, None, "skipped_high_confidence_outside_borderline"),
    ]
    d = spark.createDataFrame(rows, "available boolean, confidence double, composite long, heuristic long, expected string")
    for r in tr.gate(d).collect():
        assert r.reason == r.expected and r.asked == r.expected.startswith("fired")


def test_blend(spark):
    cols = "k int, heuristic long, model long, substance long, coherence long, poc_validity long, has_poc boolean, claimed long"
    rows = [(0, 40, None, None, None, None, False, 0), (1, 40, 60, None, None, None, False, 0), (2, 40, 60, 70, 60, 30, False, 0), (3, 40, 60, 70, 60, 20, False, 0), (4, 40, 90, 50, 50, 50, True, 1), (5, 80, 49, 50, 50, 50, True, 1)]
    got = {r.k: (r.validity, r.capped, r.floored, r.higher) for r in tr.blend(spark.createDataFrame(rows, cols)).collect()}
    assert got[0] == (40, False, False, None) and got[1] == (50, False, False, "llm")
    assert got[2] == (52, False, False, "llm")  # 60 + 3 + 1 = 64
    assert got[3] == (40, True, False, "tied") and got[4] == (40, False, True, "llm") and got[5] == (49, False, True, "heuristic")


def test_without_model(spark):
    rows = [(50, 60, 40, -5, 5, 90, 5, 90, 20, None, False, True, False, False, 2, 1, 1), (0, 0, 0, -50, 100, 100, 100, 100, 0, 0, False, False, False, False, 10, 5, 0)]
    cols = "linguistic long, template long, spectral long, human_reduction long, evidence_quality long, hallucination long, claim_specificity long, consistency long, factual long, verification long, hallucinated_function boolean, fabricated_cve boolean, future_cve boolean, fake_trace boolean, strong_markers long, markers long, human_signs long"
    a, b = tr.without_model(spark.createDataFrame(rows, cols)).orderBy("linguistic", ascending=False).collect()
    assert (a.authenticity, a.validity, a.slop_score, a.tier, a.confidence) == (50, 29, 57, "Questionable", 0.28)
    assert (b.authenticity, b.validity, b.slop_score, b.tier, b.quadrant) == (0, 100, 0, "Clean", "STRONG_HUMAN") and b.confidence == 0.85


def test_verification(spark):
    cases = [([], 50), (None, 50), ([12], 40), ([12, 10], 72), ([30, 30], 100), ([-10, -10, -10], 0), ([-20, -20], 10), ([-40, -40], 0), ([-5, 12], 40), ([None, 10, 10], 70)]
    d = spark.createDataFrame([(None if w is None else [(x,) for x in w], e) for w, e in cases], "c array<struct<weight: int>>, e long")
    assert [r[0] for r in d.select(tr.verification(F.col("c"))).collect()] == [e for _, e in cases]


def test_fabricated_flags(spark):
    own = '{"engines": [{"engine": "A"}, {"engine": "Technical Substance", "signalBreakdown": {"avri": {"rawHttp": {"isFake": true}, "crashTrace": null}}}]}'
    d = spark.createDataFrame([(own,), ("{}",), (None,), ("no json",), ('{"engines": []}',)], "j string")
    assert [tuple(r.f) for r in d.select(tr.fabricated_flags(F.col("j")).alias("f")).collect()] == [(True, False)] + [(False, False)] * 4


def test_containing_and_prefix(spark):
    d = spark.createDataFrame([(1, ["a", "b"], '["a","b"]'), (2, ["a"], "[]"), (3, None, None), (4, ["b", None], "no json")], "k int, v array<string>, j string")
    ks = lambda x: sorted(r.k for r in x.collect())
    assert ks(rl.containing(d, "v", ["a", "b"])) == [1] and ks(rl.containing(d, "j", ["b"])) == [1] and ks(rl.containing(d, "v", [])) == [1, 2, 4]
    e = spark.createDataFrame([(1, [("x_y",)]), (2, [("xzy",)]), (3, []), (4, None), (5, [(None,)])], "k int, v array<struct<type: string>>")
    assert ks(rl.with_type(e, "v", "x_")) == [1]


def test_paged(spark):
    ids = [-7, -1, 0, 3, 4, 5, 9, 40, 41, 1000]
    got = [(r.i, r.page, r.place) for r in rl.paged(spark.createDataFrame([(i,) for i in ids], "i long"), "i", 3).orderBy("i").collect()]
    assert got == [(i, k // 3 + 1, k % 3 + 1) for k, i in enumerate(ids)]
    assert rl.paged(spark.createDataFrame([], "i long"), "i", 3).count() == 0


def test_public_match(spark):
    d = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", True), (4, None, True), (5, "", False), (6, "b", None)], "doc_id long, text string, shown boolean")
    assert sorted((r.doc_id, r.match) for r in si.public_match(d, d, F.col("shown")).collect()) == [(1, 2), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_schedulers_and_heartbeats(spark):
    t = lambda s: f"2024-01-01 00:{s}"
    rows = [(1, True, t("00:00"), 100, None), (2, True, t("06:39"), 100, 300), (3, True, None, 100, None), (4, False, t("00:00"), 1, None), (5, True, t("00:00"), None, None), (6, None, t("00:00"), 1, None)]
    d = spark.createDataFrame(rows, "k int, started boolean, s string, interval_s int, retry_s int").withColumn("next_tick", F.col("s").cast("timestamp"))
    got = {r.k: (r.stalled, r.overdue) for r in mo.scheduler_health(d, F.lit(t("10:00")).cast("timestamp"), 60).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, True), 6: (False, False)}
    rows = [(1, "2023-01-01", None, [mo.HEARTBEAT]), (2, "2023-01-01", 5, [mo.HEARTBEAT]), (3, "2023-01-01", None, ["x"]), (4, "2023-12-31", None, [mo.HEARTBEAT]), (5, None, None, [mo.HEARTBEAT]), (6, "2023-01-01", None, None)]
    d = spark.createDataFrame(rows, "k int, s string, report_id long, notes array<string>").withColumn("created_at", F.col("s").cast("timestamp"))
    assert sorted(r.k for r in mo.prune_heartbeats(d, F.lit("2024-01-01").cast("timestamp")).collect()) == [2, 3, 4, 5, 6]


def test_disclosures(spark):
    d = spark.createDataFrame([*enumerate(tq.CLAIMS), (98, "")], "k int, t string")
    got = {r.k: r.n for r in d.select("k", tr.disclosures(F.col("t")).alias("n")).collect()}
    assert got[0] == ["prepared_using_ai", "generated_with_ai", "with_ai_help"] and got[1] == ["this_report_ai", "ai_generated_adjective", "named_llm_assisted"]
    assert got[2] == ["with_ai_help", "used_llm_to_draft"] and got[3] == got[98] == []
    more = d.select(tr.disclosure_penalty(tr.disclosures(F.col("t"), [("mine", "not a disclosure", "i")])).alias("p")).collect()
    assert [r.p for r in more][3] == 15 and sum(r.p for r in more) == 15


def test_coherence_issues(spark):
    rows = [
        (4, "MEMORY_CORRUPTION", [("CVSS_VS_FAMILY", 5)]), (4, "WEB_CLIENT", [("FAMILY_VS_IMPACT", 6), ("FAMILY_VS_REPRO", 8), ("CVSS_VS_FAMILY", 5)]), (4, "AUTHN_AUTHZ", [("FAMILY_VS_IMPACT", 6), ("FAMILY_VS_REPRO", 8), ("CVSS_VS_FAMILY", 4)]),
        (5, "AUTHN_AUTHZ", [("CVSS_VS_LANGUAGE", 6)]), (6, "WEB_CLIENT", [("CVSS_VS_LANGUAGE", 6)]), (7, "CRYPTO", []), (6, "FLAT", []), (6, "other", [("CVSS_VS_LANGUAGE", 6)]), (6, None, [("CVSS_VS_LANGUAGE", 6)]), (3, "INJECTION", [("FAMILY_VS_IMPACT", 6), ("FAMILY_VS_REPRO", 8)]),
    ]
    d = spark.createDataFrame([(tq.CLAIMS[k], f, i) for i, (k, f, _) in enumerate(rows)], "t string, f string, i int")
    got = {r.i: [tuple(x) for x in r.x] for r in d.select("i", tr.coherence_issues(F.col("t"), F.col("f")).alias("x")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(rows)}


def test_poc_checks(spark):
    d = spark.createDataFrame([*enumerate(tq.CLAIMS), (98, "")], "k int, t string").select("k", tr.poc_checks(F.col("t")).alias("c"))
    got = {r.k: ([x.type for x in r.c], r.s) for r in d.select("*", tr.verification(F.col("c")).alias("s")).collect()}
    staged, bare = "poc_placeholder_textbook", "poc_fabricated_response"
    assert got[8] == ([staged, bare], 72) and got[9] == ([], 50) and got[10] == ([staged, staged, bare], 84) and got[98] == ([], 50)
