"""Queries of pre-filters, fabrication checks, fusion and rule dry runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detector_rules as R
from ..functions.feature_rules import sql
from ..functions.text import d_count, d_found, d_normalise, duck, normalise
from ..operators import detectors as de
from ..operators import monitoring as mo
from .registry import query, read

_YEAR = 2026
#: The documents have no such content: half of them get a line of it.
_LINES = (
    "Please whitelist us. Send my bounty first.", "Pay $500 before Friday or we publish on a leak site within 48 hours.", "CVE-20-123 and CVE-2031-12345, CVE-1990-1234.", "Critical severity! CVSS: 11.5 CWE-1 CWE-2 CWE-3 CWE-4 CWE-5",
    "Dear team, CVE-2020-10001 CVE-2020-10002 CVE-2020-10003 CVE-2020-12000 CVE-2020-13000", "OWASP Top 10 CWE-1 CWE-2 CWE-3 rce vulnerability",
)
_CASE = "CASE " + " ".join(f"WHEN doc_id % 12 = {k} THEN '{line}'" for k, line in enumerate(_LINES)) + " ELSE '' END"
_T = f"(SELECT doc_id, lang, n_chars, text || ' ' || {_CASE} AS t FROM documents)"


def _marked(spark, sf_dir):
    line = F.lit("")
    for k, text in enumerate(_LINES):
        line = F.when(F.col("doc_id") % 12 == k, text).otherwise(line)
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.concat("text", F.lit(" "), line).alias("text"))


_FIRES = " UNION ALL ".join(
    [f"SELECT doc_id, '{fam}' AS family, '{flag}' AS flag, {sev} AS severity FROM t WHERE {d_found('t', p, f)}" for fam, flag, sev, p, f in R.PREFILTER]
    + [
        f"SELECT doc_id, 'cve_validation', 'hallucinated_cve_format', 3 FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, {duck(R.LOOSE_CVE)}))) AS c FROM t) WHERE NOT regexp_matches(c, '^CVE-\\d{{4}}-\\d{{4,}}$')",
        f"SELECT doc_id, 'cve_validation', 'future_year_cve', 3 FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(t, {duck(R.STRICT_CVE)}))) AS c FROM t) WHERE CAST(substr(c, 5, 4) AS INT) > {_YEAR}",
    ]
)
_HIGH = ", ".join(f"'{k}'" for k, v in R.ROUTES.items() if v[2] == 3)
_PRE = f"""
    t AS {_T}, f AS ({_FIRES}), s AS (SELECT t.doc_id, coalesce(sum(severity), 0) AS total, count(*) FILTER (family IN ({_HIGH})) > 0 AS high FROM t LEFT JOIN f USING (doc_id) GROUP BY 1)"""


@query(f"""
    WITH {_PRE} SELECT doc_id, CAST(total AS BIGINT) AS total_severity, total >= 3 AS quarantined, CASE WHEN total >= 3 AND high THEN 'legal_ir_soc' WHEN total >= 3 THEN 'psirt_triage' END AS route,
        CASE WHEN total >= 3 AND high THEN 0e0 WHEN total >= 3 THEN 0.2e0 END AS realness_cap FROM s""")
def prefilter(spark, sf_dir):
    return de.prefilter(_marked(spark, sf_dir), year=_YEAR).select("doc_id", "total_severity", "quarantined", "route", "realness_cap")


@query(f"WITH {_PRE} SELECT family, flag, count(*) AS fires, count(DISTINCT doc_id) AS documents FROM f GROUP BY 1, 2")
def prefilter_summary(spark, sf_dir):
    d = de.prefilter(_marked(spark, sf_dir), year=_YEAR).select("doc_id", F.inline("fires"))
    return d.groupBy("family", "flag").agg(F.count("*").alias("fires"), F.countDistinct("doc_id").alias("documents"))


_SUP = " OR ".join(d_found("t", p, "i") for p in R.SEVERITY_SUPPORT)
_NAMED = d_found("t", R.NAMED_CLASS, "i")
_CWES = d_count("t", r"cwe-?\d+", "i")
_LOG = "CAST(least(100, floor(30 * ln(1 + w) + 0.5)) AS BIGINT)"


@query(f"""
    WITH x AS (SELECT doc_id, CASE WHEN {d_found('t', R.SEVERITY_CLAIM, 'i')} AND NOT ({_SUP}) THEN 15 ELSE 0 END
        + 10 * len(list_filter(regexp_extract_all(t, {duck(R.CVSS, 'i')}, 1), lambda v: CAST(v AS DOUBLE) > 10)) + CASE WHEN {_CWES} >= 5 AND NOT {_NAMED} THEN 8 ELSE 0 END
        + CASE WHEN {d_found('t', R.OWASP, 'i')} AND {_CWES} >= 3 AND NOT {_NAMED} THEN 6 ELSE 0 END AS w FROM {_T})
    SELECT doc_id, CAST(w AS BIGINT) AS weight, {_LOG} AS score FROM x""")
def severity_inflation(spark, sf_dir):
    d = _marked(spark, sf_dir).select("doc_id", de.severity_inflation(F.col("text")).alias("weight"))
    return d.withColumn("score", de.log_score(F.col("weight")))


_CVE = r"list_transform(regexp_extract_all(t, 'CVE-\d{4}-\d{4,}'), lambda m: {'y': CAST(substr(m, 5, 4) AS INT), 'i': CAST(substr(m, 10) AS BIGINT)})"


@query(f"""
    WITH x AS (SELECT doc_id, {_CVE} AS c FROM {_T}) SELECT doc_id, CAST(20 * len(list_filter(c, lambda v: v.y > {_YEAR + 1})) + 15 * len(list_filter(c, lambda v: v.y < 1999))
        + CASE WHEN len(c) >= 5 AND len(list_distinct(list_transform(c, lambda v: v.y))) = 1 THEN 8 ELSE 0 END AS BIGINT) AS weight FROM x""")
def cve_year_checks(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", de.cve_years(F.col("text"), _YEAR).alias("weight"))


@query(f"""
    WITH x AS (SELECT doc_id, t, {_CVE} AS c FROM {_T}), y AS (SELECT *, list_sort(list_transform(c, lambda v: v.i)) AS s FROM x)
    SELECT doc_id, CAST(CASE WHEN len(c) >= 2 AND len(list_filter(list_zip(s[1:len(s) - 1], s[2:]), lambda z: z[2] - z[1] = 1)) >= 2
            THEN CASE WHEN {d_found('t', R.RESEARCHER, 'i')} AND len(list_filter(c, lambda v: {_YEAR} - v.y > 1)) = 0 THEN 0 WHEN {d_found('t', R.TEMPLATED, 'i')} THEN 12 ELSE 5 END ELSE 0 END
        + CASE WHEN len(list_filter(c, lambda v: v.i % 1000 = 0)) >= 2 THEN 10 ELSE 0 END + 8 * len(list_filter(c, lambda v: length(CAST(v.i AS VARCHAR)) > 7)) AS BIGINT) AS weight FROM y""")
def fabricated_cves(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", de.fabricated_cves(F.col("text"), _YEAR).alias("weight"))


_AXES = {
    "lexical": "p_partkey * 7 % 101", "statistical": "p_partkey * 13 % 101", "template": "p_partkey * 17 % 101", "spectral": "p_partkey * 19 % 101", "human_reduction": "-(p_partkey * 23 % 30)", "evidence_quality": "p_partkey * 29 % 101",
    "hallucination": "p_partkey * 31 % 101", "claim_specificity": "p_partkey * 37 % 101", "consistency": "p_partkey * 41 % 101", "factual": "p_partkey * 43 % 101", "verified": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 ELSE 0 END",
    "verification": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 47 % 101 END", "hallucinated_function": "p_partkey % 11 = 0", "fabricated_cve": "p_partkey % 13 = 0", "future_cve": "p_partkey % 17 = 0", "fake_trace": "p_partkey % 19 = 0",
    "strong_markers": "p_partkey % 9", "markers": "p_partkey % 12", "human_signs": "p_partkey % 6",
}
_START = f"f AS (SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in _AXES.items())} FROM part)"
_STEPS = ", ".join(f"f{i} AS (SELECT *, {', '.join(f'{sql(v)} AS {k}' for k, v in stage.items())} FROM f{i - 1 if i else ''})" for i, stage in enumerate(R.FUSION))


@query(f"WITH {_START}, {_STEPS} SELECT p_partkey, authenticity, validity, substance_axis, slop_score, tier, quadrant, archetype, confidence FROM f{len(R.FUSION) - 1}")
def fused_scores(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in _AXES.items()])
    return de.fuse(p).select("p_partkey", "authenticity", "validity", "substance_axis", "slop_score", "tier", "quadrant", "archetype", "confidence")


_LEVEL = "CASE WHEN n_chars % 100 >= 80 THEN 'Slop' WHEN n_chars % 100 >= 60 THEN 'Likely Slop' WHEN n_chars % 100 >= 40 THEN 'Questionable' WHEN n_chars % 100 >= 20 THEN 'Likely Human' ELSE 'Clean' END"


@query(f"SELECT {_LEVEL} AS tier, count(*) AS matches, {_LEVEL} IN ('Clean', 'Likely Human') AS false_positive FROM documents WHERE contains({d_normalise('text')}, 'the and') GROUP BY ALL")
def phrase_dry_run(spark, sf_dir):
    return mo.phrase_dry_run(read(spark, sf_dir, "documents"), normalise("text"), F.expr(_LEVEL), "the and")


@query(f"SELECT doc_id FROM documents WHERE (contains({d_normalise('text')}, 'the and') OR contains({d_normalise('text')}, 'of the')) AND NOT contains({d_normalise('text')}, 'is the')")
def phrase_removal_impact(spark, sf_dir):
    return mo.phrase_removal(read(spark, sf_dir, "documents"), normalise("text"), ["the and", "of the"], ["is the"]).select("doc_id")


@query("SELECT value, count(*) AS reports, floor(avg(n_chars) * 10 + 0.5) / 10 AS avg_score FROM (SELECT regexp_extract_all(lower(text), '[a-z]{12,}')[1] AS value, n_chars FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z]{12,}')) > 0) GROUP BY 1")
def inferred_cwe_stats(spark, sf_dir):
    """First match per document, counted per value (long words stand in for CWE ids)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{12,}"), F.lit(0)).alias("v"))
    return mo.first_match_stats(d, "doc_id", "v", "n_chars")


@query("""
    WITH RECURSIVE e AS (SELECT n_nationkey + 100 AS cwe, n_regionkey + 10 AS parent FROM nation UNION ALL SELECT r_regionkey + 10, CASE WHEN r_regionkey = 0 THEN 1 ELSE 10 END FROM region),
    w(cwe, ancestor, distance) AS (SELECT cwe, parent, 1 FROM e UNION SELECT w.cwe, e.parent, distance + 1 FROM w JOIN e ON e.cwe = w.ancestor WHERE distance < 6)
    SELECT cwe, ancestor, min(distance) AS distance FROM w GROUP BY 1, 2""")
def cwe_ancestors(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("cwe"), (F.col("n_regionkey") + 10).alias("parent"))
    r = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 10).alias("cwe"), F.when(F.col("r_regionkey") == 0, 1).otherwise(10).alias("parent"))
    return de.cwe_closure(n.unionByName(r))
