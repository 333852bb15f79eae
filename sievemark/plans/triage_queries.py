"""Queries of vulnerability classes, second opinions, checks, schedulers and stored rows. Inputs that the tables lack are computed from keys, or appended to the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import triage_rules as R
from ..functions.claim_rules import PLACEHOLDER_DOMAINS
from ..functions.feature_rules import sql
from ..functions.text import D_SPACE, d_count, d_found, duck
from ..operators import monitoring as mo
from ..operators import relational as rl
from ..operators import similarity as si
from ..operators import triage as tr
from .registry import EVENTS_NOW, ORDERS_NOW, events_now, orders_now, query, read

TEXTS = (
    "A stored XSS: <script>alert(1)</script> reads document.cookie with onerror.", "Blind SQL injection, union select 1 and sleep(5) or 1=1 (SQLi).", "An SSRF reaches 169.254.169.254, the cloud metadata endpoint.",
    "pickle and a gadget chain: insecure deserialization", "AddressSanitizer: heap overflow after a use-after-free", "path traversal with ../../etc/passwd", "An IDOR gives privilege escalation.", "TOCTOU race condition",
    "one race condition and one SQL injection", "xss in lower case is not its name",
)
_N = len(TEXTS) + 3
_CASE = "CASE " + " ".join(f"WHEN doc_id % {_N} = {k} THEN '{x}'" for k, x in enumerate(TEXTS)) + " ELSE '' END"
_SHARES = ", ".join(
    f"{{'s': ({' + '.join(f'CAST({d_found(chr(116), p, f)} AS INT)' for p, f in patterns)}) / {len(patterns)}e0, 'i': -{i}, 'n': '{name}', 'l': '{label}'}}" for i, (name, (label, patterns)) in enumerate(R.CLASSES.items())
)


@query(f"""
    WITH x AS (SELECT doc_id, coalesce(text, '') || chr(10) || {_CASE} AS t FROM documents), y AS (SELECT doc_id, list_max([{_SHARES}]) AS b FROM x)
    SELECT doc_id, CASE WHEN b.s > 0 THEN b.n ELSE '{R.UNKNOWN[0]}' END AS name, CASE WHEN b.s > 0 THEN b.l ELSE '{R.UNKNOWN[1]}' END AS label, CASE WHEN b.s >= 0.4e0 THEN 0.9e0 WHEN b.s >= 0.2e0 THEN 0.6e0 WHEN b.s > 0 THEN 0.3e0 ELSE 0e0 END AS confidence FROM y""")
def vuln_classes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_CASE)).alias("text"))
    return d.select("doc_id", tr.vuln_class(F.col("text")).alias("c")).select("doc_id", "c.*")


CLAIMS = (
    "Prepared using an AI\nsecurity assistant, and written with the help of ChatGPT.", "This report was generated with a tool of an LLM. AI-generated, Claude-assisted.", "We asked an AI to draft it, with assistance from Gemini.",
    "Our AI product is not a disclosure.", "CVSS:3.1/AV:P/AC:L/UI:N/PR:N and reflected input; an admin; a crash seen in gdb", "CVSS: 9.8, this might allow account takeover with alice and bob", "CVSS 10 but theoretical: cookie theft in the browser",
    "key recovery, shown with python and hashlib; CVSS:3.0/AV:L/UI:N stored", "curl http://target.com/?q=<script>alert(1)\nHTTP/1.1 200 OK\n\nbody", "wget http://real.host/etc/passwd x\nHTTP/1.1 200 OK\nDate: now\n\nbody\nHTTP/2 404\nX-A: 1\nX-B: 2\n\n",
    "python poc.py --url http://victim.com --cmd 'nc -e /bin/sh'\nperl -e x http://acme.com/ union  select\nHTTP/1.0 500\nX-A: 1",
)
_M = len(CLAIMS) + 2
_CLAIM = "CASE " + " ".join(f"WHEN doc_id % {_M} = {k} THEN " + "'" + x.replace("'", "''") + "'" for k, x in enumerate(CLAIMS)) + " ELSE '' END"
_CLAIMED = f"(SELECT doc_id, coalesce(text, '') || chr(10) || {_CLAIM} AS t FROM documents)"


def _claimed(spark, sf_dir):
    more = F.lit("")
    for k, x in enumerate(CLAIMS):
        more = F.when(F.col("doc_id") % _M == k, x).otherwise(more)
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more).alias("text"))


_TOLD = ", ".join(f"CASE WHEN {d_found('s', p, f)} THEN '{n}' END" for n, p, f in R.DISCLOSURE)


@query(f"SELECT doc_id, names, CAST(CASE WHEN names <> '' THEN 15 ELSE 0 END AS BIGINT) AS penalty FROM (SELECT doc_id, concat_ws(',', {_TOLD}) AS names FROM (SELECT doc_id, regexp_replace(t, '{D_SPACE}', ' ', 'g') AS s FROM {_CLAIMED}))")
def ai_disclosures(spark, sf_dir):
    d = _claimed(spark, sf_dir).select("doc_id", tr.disclosures(F.col("text")).alias("n"))
    return d.select("doc_id", F.array_join("n", ",").alias("names"), tr.disclosure_penalty(F.col("n")).alias("penalty"))


_FAMILY = "CASE doc_id // 13 % 9 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(R.FAMILIES)) + " ELSE 'FLAT' END"
_LACKS = lambda k: " OR ".join(f"(family = '{n}' AND NOT {d_found('t', ps[k], 'i')})" for n, ps in R.FAMILIES.items())
_FIELD = lambda k: f"coalesce(string_split(list_filter(string_split(v, '/'), lambda p: regexp_matches(p, '^{k}:[^:]'))[-1], ':')[2], '')"


def coherence_sql(source: str) -> str:
    """(doc_id, family, issues, penalty) over a source of (doc_id, t, family)."""
    return f"""
    WITH a AS (SELECT *, regexp_extract(t, {duck(*R.CVSS_VECTOR)}, 1) AS v FROM {source}),
    b AS (SELECT *, {_FIELD('UI')} AS ui, {_FIELD('AV')} AS av, {_FIELD('PR')} AS pr, TRY_CAST(CASE WHEN v = '' THEN regexp_extract(t, {duck(*R.CVSS_SCORE)}, 1) ELSE regexp_extract(t, {duck(*R.CVSS_SCORE_FAR)}, 1) END AS DOUBLE) AS base FROM a),
    c AS (SELECT doc_id, family, CASE WHEN {_LACKS(0)} THEN 6 ELSE 0 END AS impact, CASE WHEN {_LACKS(1)} THEN 8 ELSE 0 END AS repro,
        CASE WHEN (family = 'WEB_CLIENT' AND ui = 'N' AND {d_found('t', *R.XSS_WORDS)}) OR (family = 'MEMORY_CORRUPTION' AND av NOT IN ('', 'N', 'L')) THEN 5 WHEN family = 'AUTHN_AUTHZ' AND pr = 'N' AND {d_found('t', *R.POWER_WORDS)} THEN 4 ELSE 0 END AS odd,
        CASE WHEN family <> 'FLAT' AND base >= 9 AND {d_found('t', *R.HEDGED)} THEN 6 ELSE 0 END AS hedged FROM b)
    SELECT doc_id, family, concat_ws(',', CASE WHEN impact > 0 THEN 'FAMILY_VS_IMPACT' END, CASE WHEN repro > 0 THEN 'FAMILY_VS_REPRO' END, CASE WHEN odd > 0 THEN 'CVSS_VS_FAMILY' END, CASE WHEN hedged > 0 THEN 'CVSS_VS_LANGUAGE' END) AS issues,
        CAST(impact + repro + odd + hedged AS BIGINT) AS penalty FROM c"""


@query(coherence_sql(f"(SELECT *, {_FAMILY} AS family FROM {_CLAIMED})"))
def coherence_issues(spark, sf_dir):
    """The family is dealt by id, so that each meets each text of ours."""
    names = F.array(*[F.lit(n) for n in R.FAMILIES], F.lit("FLAT"))
    d = _claimed(spark, sf_dir).withColumn("family", F.element_at(names, (F.floor(F.col("doc_id") / 13) % 9 + 1).cast("int")))
    d = d.select("doc_id", "family", tr.coherence_issues(F.col("text"), F.col("family")).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, i: a + i["penalty"])
    return d.select("doc_id", "family", F.array_join(F.transform("x", lambda i: i["id"]), ",").alias("issues"), total.alias("penalty"))


_HOST = " OR ".join(f"contains(lower(x), '{h}')" for h in PLACEHOLDER_DOMAINS if h.endswith((".com", ".org", ".net")))
_PAYLOAD = " OR ".join(d_found("x", p, "i") for p in R.TEXTBOOK)


@query(f"""
    WITH a AS (SELECT doc_id, len(list_filter(regexp_extract_all(t, {duck(*R.POC_COMMAND)})[1:10], lambda x: ({_HOST}) AND ({_PAYLOAD}))) AS staged,
        len(list_filter(regexp_extract_all(t, {duck(*R.POC_RESPONSE)})[1:5], lambda x: {d_count('x', *R.HEADER)} < 2 AND NOT {d_found('x', *R.REAL_HEADER)})) AS bare FROM {_CLAIMED})
    SELECT doc_id, CAST(staged AS BIGINT) AS staged, CAST(bare AS BIGINT) AS bare, CAST(CASE WHEN staged + bare = 1 THEN 40 ELSE least(100, 50 + 12 * staged + 10 * bare) END AS BIGINT) AS score FROM a""")
def poc_plausibility(spark, sf_dir):
    d = _claimed(spark, sf_dir).select("doc_id", tr.poc_checks(F.col("text")).alias("c"))
    n = lambda w: F.size(F.filter("c", lambda x: x["weight"] == w)).cast("bigint")
    return d.select("doc_id", n(12).alias("staged"), n(10).alias("bare"), tr.verification(F.col("c")).alias("score"))


def _steps(start: dict[str, str], stages) -> str:
    """SQL of stages over columns computed from parts, as a WITH clause that ends in ``last``."""
    out = [f"x0 AS (SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in start.items())} FROM part)"]
    out += [f"x{i + 1} AS (SELECT *, {', '.join(f'{sql(v)} AS {k}' for k, v in s.items())} FROM x{i})" for i, s in enumerate(stages)]
    return f"WITH {', '.join(out)}, last AS (SELECT * FROM x{len(out) - 1})"


def _parts(spark, sf_dir, start):
    return read(spark, sf_dir, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in start.items()])


_ASKED = {"available": "p_partkey % 9 <> 0", "confidence": "CAST(p_partkey % 10 AS DOUBLE) / 10", "composite": "CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 7 % 101 END", "heuristic": "p_partkey * 13 % 101"}


@query(f"{_steps(_ASKED, R.GATE)} SELECT p_partkey, reason, asked FROM last")
def llm_gate(spark, sf_dir):
    return tr.gate(_parts(spark, sf_dir, _ASKED)).select("p_partkey", "reason", "asked")


_OPINIONS = {
    "heuristic": "p_partkey * 7 % 101", "model": "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 13 % 101 END", "substance": "CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 17 % 101 END", "coherence": "p_partkey * 19 % 101",
    "poc_validity": "p_partkey * 23 % 41", "has_poc": "p_partkey % 4 = 0", "claimed": "p_partkey % 2",
}


@query(f"{_steps(_OPINIONS, R.BLEND)} SELECT p_partkey, CAST(validity AS BIGINT) AS validity, CAST(model_validity AS BIGINT) AS model_validity, capped, floored, higher FROM last")
def llm_blend(spark, sf_dir):
    d = tr.blend(_parts(spark, sf_dir, _OPINIONS))
    return d.select("p_partkey", F.col("validity").cast("bigint").alias("validity"), F.col("model_validity").cast("bigint").alias("model_validity"), "capped", "floored", "higher")


_STORED = {
    "linguistic": "p_partkey * 7 % 101", "template": "p_partkey * 17 % 101", "spectral": "p_partkey * 19 % 101", "human_reduction": "-(p_partkey * 23 % 30)", "evidence_quality": "p_partkey * 29 % 101", "hallucination": "p_partkey * 31 % 101",
    "claim_specificity": "p_partkey * 37 % 101", "consistency": "p_partkey * 41 % 101", "factual": "p_partkey * 43 % 101", "verification": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 47 % 101 END", "hallucinated_function": "p_partkey % 11 = 0",
    "fabricated_cve": "p_partkey % 13 = 0", "future_cve": "p_partkey % 17 = 0", "fake_trace": "p_partkey % 19 = 0", "strong_markers": "p_partkey % 9", "markers": "p_partkey % 12", "human_signs": "p_partkey % 6",
}


@query(f"{_steps(_STORED, R.WITHOUT_MODEL)} SELECT p_partkey, authenticity, validity, slop_score, tier, quadrant, archetype, confidence FROM last")
def rescored_without_llm(spark, sf_dir):
    return tr.without_model(_parts(spark, sf_dir, _STORED)).select("p_partkey", "authenticity", "validity", "slop_score", "tier", "quadrant", "archetype", "confidence")


_WEIGHT = "CAST(l_quantity AS BIGINT) % 23 - 14"


@query(f"""
    WITH x AS (SELECT l_orderkey, count(*) FILTER (w > 0) AS bad, count(*) FILTER (w < 0) AS good, CAST(sum(w) AS BIGINT) AS total FROM (SELECT l_orderkey, {_WEIGHT} AS w FROM lineitem) GROUP BY 1)
    SELECT l_orderkey, CAST(CASE WHEN good >= 3 AND bad = 0 THEN greatest(0, 10 - 5 * good) ELSE least(100, greatest(0, CASE WHEN bad < 2 AND total > 0 THEN least(50 + total, 40) ELSE 50 + total END)) END AS BIGINT) AS score FROM x""")
def verification_scores(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.expr(_WEIGHT).alias("weight"))).alias("checks"))
    return l.select("l_orderkey", tr.verification(F.col("checks")).alias("score"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 4 = 1 AS fake_raw_http, o_orderkey % 3 <> 0 AND o_orderkey % 5 = 1 AS stripped_crash_trace FROM orders")
def fabricated_flags(spark, sf_dir):
    """Results of orders divisible by 3 have no substance engine."""
    inner = F.concat(
        F.lit('{"avri": {"rawHttp": '), F.expr("CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 4 <> 1 THEN 'null' ELSE '{\"isFake\": ' || CAST(o_orderkey % 4 = 1 AS STRING) || '}' END"), F.lit(', "crashTrace": {"isStripped": '),
        F.expr("CAST(o_orderkey % 5 = 1 AS STRING)"), F.lit("}}}"),
    )
    name = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'Style' WHEN o_orderkey % 2 = 0 THEN 'TECHNICAL Substance v2' ELSE 'Technical substance' END")
    j = F.concat(F.lit('{"engines": [{"engine": "AI Authorship", "signalBreakdown": {"avri": {"rawHttp": {"isFake": true}}}}, {"engine": "'), name, F.lit('", "signalBreakdown": '), inner, F.lit("}]}"))
    return read(spark, sf_dir, "orders").select("o_orderkey", tr.fabricated_flags(j).alias("f")).select("o_orderkey", "f.*")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def array_containment(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_returnflag")).alias("flags"))
    return rl.containing(l, "flags", ["A", "R"]).select("l_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber % 3 = 1 AND l_suppkey % 4 = 0)")
def escaped_prefix(spark, sf_dir):
    """An underscore in the prefix is no wildcard: ``hallucinationXpid`` is not among the evidence asked for."""
    kind = F.expr("CASE WHEN l_suppkey % 4 <> 0 THEN 'ai_phrase' WHEN l_linenumber % 3 = 1 THEN 'hallucination_pid' ELSE 'hallucinationXpid' END")
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("type"))).alias("evidence"))
    return rl.with_type(l, "evidence", "hallucination_").select("l_orderkey")


@query("SELECT o_orderkey, (r - 1) // 500 + 1 AS page, (r - 1) % 500 + 1 AS place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)")
def sitemap_pages(spark, sf_dir):
    return rl.paged(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("""
    WITH p AS (SELECT coalesce(text, '') AS t, min(doc_id) AS match FROM documents WHERE n_chars % 2 = 0 GROUP BY 1)
    SELECT doc_id, match FROM documents JOIN p ON t = coalesce(text, '') WHERE doc_id % 100 = 0""")
def public_matches(spark, sf_dir):
    """Rows of even length stand in for public ones."""
    d = read(spark, sf_dir, "documents")
    return si.public_match(d.where("doc_id % 100 = 0"), d, F.col("n_chars") % 2 == 0)


_TICKS = f"""SELECT p_partkey, p_partkey % 5 <> 0 AS started, CASE WHEN p_partkey % 7 <> 0 THEN TIMESTAMP '{EVENTS_NOW}' - INTERVAL '1' SECOND * (p_partkey * 37 % 1200) END AS next_tick,
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 4 * 100 END AS interval_s, CASE WHEN p_partkey % 2 = 0 THEN 200 END AS retry_s FROM part"""


@query(f"""
    SELECT p_partkey, coalesce(started AND late > 2 * interval_s, false) AS stalled, coalesce(started AND late > coalesce(retry_s, 0) + 60, false) AS overdue
    FROM (SELECT *, epoch(TIMESTAMP '{EVENTS_NOW}') - epoch(next_tick) AS late FROM ({_TICKS}))""")
def scheduler_health(spark, sf_dir):
    k = F.col("p_partkey")
    tick = F.timestamp_seconds(F.unix_timestamp(events_now()) - k * 37 % 1200)
    p = read(spark, sf_dir, "part").select("p_partkey", (k % 5 != 0).alias("started"), F.when(k % 7 != 0, tick).alias("next_tick"), F.when(k % 11 != 0, k % 4 * 100).alias("interval_s"), F.when(k % 2 == 0, 200).alias("retry_s"))
    return mo.scheduler_health(p, events_now(), 60).select("p_partkey", "stalled", "overdue")


@query(f"""
    WITH t AS (SELECT n_nationkey AS replica, unnest(generate_series(TIMESTAMP '1998-06-01', TIMESTAMP '1998-08-02', INTERVAL 6 HOUR)) AS created_at, NULL AS report_id, true AS beat FROM nation
        UNION ALL SELECT o_custkey % 25, o_orderdate, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END, o_orderkey % 2 = 0 FROM orders)
    SELECT replica, count(*) AS traces, count(*) FILTER (beat) AS beats, count(report_id) AS reports FROM t WHERE NOT (created_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 30 DAY AND report_id IS NULL AND beat) GROUP BY 1""")
def heartbeat_retention(spark, sf_dir):
    """Traces of reports (orders stand in) and synthetic ones after a prune, by replica."""
    beats = mo.heartbeats(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("replica")), F.lit("1998-06-01").cast("timestamp"), F.lit("1998-08-02").cast("timestamp"), "6 HOURS")
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    own = o.select((F.col("o_custkey") % 25).alias("replica"), F.col("o_orderdate").alias("created_at"), F.when(key % 3 != 0, key).alias("report_id"), F.when(key % 2 == 0, F.array(F.lit("slow"), F.lit(mo.HEARTBEAT))).otherwise(F.array(F.lit("slow"))).alias("notes"))
    left = mo.prune_heartbeats(beats.unionByName(own), orders_now())
    return left.groupBy("replica").agg(F.count("*").alias("traces"), F.count_if(F.array_contains("notes", mo.HEARTBEAT)).alias("beats"), F.count("report_id").alias("reports"))
