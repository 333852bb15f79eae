"""Gaps and advice, projects and code named, impossible answers: expectations made by hand. The SQL of the queries is held in test_oracles."""

import time

from pyspark.sql import functions as F

from sievemark.functions import advice_rules as A
from sievemark.operators import advice as ad
from sievemark.operators import excerpts as ex
from sievemark.plans import advice_queries as aq


def texts(spark):
    return spark.createDataFrame([*enumerate(aq.TEXTS), (98, None), (99, "")], "k int, text string")


def test_advice(spark):
    nothing = "CAST(NULL AS int)"
    d = texts(spark).withColumns({"slop": F.lit(50), "confidence": F.lit(0.9), "placeholders": (F.col("k") == 0).cast("int"), "fabricated": F.col("k") == 4, "verified": F.expr(nothing), "not_found": F.expr(nothing), "steps": F.lit("own")})
    got = {r.k: r for r in ad.advise(d).collect()}
    gaps = lambda k: [g.category for g in got[k].gaps]
    assert gaps(0) == [
        "missing_version", "missing_poc", "missing_repro_steps", "placeholder_artifacts", "missing_impact", "missing_environment", "missing_http_detail", "missing_remediation", "missing_cvss", "missing_source_location",
    ]
    assert gaps(1) == [] and got[1].strengths == ["code", "steps", "versions", "tools"] and got[1].actionability == "high"
    assert got[1].clarity == 95  # 50 + 12 + 10 + 8 + 8 + 7
    assert {"single_version_only", "narrative_poc_only"} <= set(gaps(2)) and got[2].areas[:3] == ["Attack Chain", "RCE Claim", "Multiple CVEs"]
    assert {"missing_dependency_version", "missing_auth_context", "missing_network_position", "missing_cvss"} <= set(gaps(3))
    assert "Fabricated Debug Output" in got[4].areas and "missing_source_location" not in gaps(4)
    assert [f.kind for f in got[0].feedback] == ["critical_gaps", "mixed", "template_opening"] and got[0].steps == "own"
    assert got[98].gaps == got[99].gaps and got[99].areas == ["Ambiguous Score", "Dependency Tree"] and (got[99].clarity, got[99].actionability) == (11, "low")


def test_advice_without_findings(spark):
    d = spark.createDataFrame([(aq.TEXTS[1], None, None, None, None, None, None), ("", 30, 0.1, 0, False, 3, 0)], "text string, slop int, confidence double, placeholders int, fabricated boolean, verified int, not_found int")
    a, b = ad.advise(d).collect()
    assert [f.kind for f in a.feedback] == ["strengths"] and a.areas[0] == "Dependency Tree"
    assert [f.kind for f in b.feedback] == ["critical_gaps", "verified"]
    assert ad.advise(d.limit(0)).count() == 0


def test_projects_and_references(spark):
    d = texts(spark).select("k", ad.projects(F.coalesce("text", F.lit(""))).alias("p"), ad.code_references(F.coalesce("text", F.lit(""))).alias("c"))
    got = {r.k: ([tuple(p) for p in r.p], r.c) for r in d.collect()}
    assert got[5][0] == [
        ("curl", "curl/curl", "github_url"), ("c.d", "a-b/c.d", "github_url"), ("f", "e/f", "gitlab_url"), ("node", "nodejs/node", "github_url"), ("django", "django/django", "github_url"), ("flask", "pallets/flask", "known_project"),
        ("redis", "redis/redis", "known_project"), ("git", "git/git", "github_url"), ("left-pad", "left-pad", "npm_package"), ("@x/y", "@x/y", "npm_package"),
    ]
    assert got[6][1].functions == ["parse_it", "on_data", "read_all", "Foo::bar", "do_work", "copy"] and got[6][1].paths == ["src/core/io.c", "b/c.py"]  # a bracket starts no path, a slash does; one that begins with http is an address
    assert got[98][0] == got[99][0] == [] and got[99][1].functions == got[99][1].paths == []


def test_impossible_excerpts(spark):
    d = texts(spark).select("k", ex.impossible_http(F.col("text")).alias("h"), ex.impossible_graphql(F.col("text")).alias("g"))
    got = {r.k: (r.h, r.g) for r in d.collect()}
    assert got[7][0] == [
        "content_length_zero_but_body_present", "request_carries_response_only_set-cookie", "response_carries_request_only_cookie", "response_to_HEAD_must_have_no_body", "status_200_with_wrong_reason_phrase",
    ]
    assert got[8][0] == ["content_length_declared_but_body_empty", "content_length_disagrees_with_body", "response_carries_request_only_origin", "status_204_must_have_no_body"]
    assert got[9] == ([], [])  # a line right after a start line is none; outside fences nothing counts
    assert got[10][1] == ["data_null_with_no_errors", "empty_errors_array"]
    assert got[11][1] == ["error_path_references_unknown_field", "errored_field_not_null", "fabricated_extensions_code"]
    assert got[12][1] == ["fabricated_extensions_code"] and got[98] == got[99] == ([], [])


def test_projects_far_into_a_long_text(spark):
    """A version counts up to 80 characters from the first place of a name, characters beyond 16 bits too; names are found without a try at every place before them."""
    fill, pad = "x" * 200000, "\U0001d4b3" * 76
    cases = [f"{fill} 1.2{pad} nginx {fill}", f"{fill} 1.2x{pad} nginx {fill}", f"nginx {'y' * 200} nginx 1.2", f"nginx {pad}1.2", f"nginx x{pad}1.2", "NGINX version 3"]
    d = spark.createDataFrame(list(enumerate([*cases, f"{fill} {' '.join(A.PROJECTS)}"])), "k int, text string")
    start = time.monotonic()
    got = {r.k: [(p.name, p.source) for p in r.p] for r in d.select("k", ad.projects(F.col("text")).alias("p")).collect()}
    assert time.monotonic() - start < 20
    assert [got[k] for k in range(6)] == [[("nginx", s)] for s in ("github_url", "known_project", "known_project", "github_url", "known_project", "github_url")]
    assert len(got[6]) == A.MOST_PROJECTS


def test_gaps_are_counted_without_a_filter_over_the_text(spark):
    from conftest import DATA

    plan = aq.gap_counts(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]  # a filter takes the expressions of its columns over and reads each text anew
