"""Queries of families, of their rubrics' engines, and of the composites made of those. Texts of ours, after the documents' own, name and show vulnerabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import family_rules as FR
from ..functions import rubric_rules as R
from ..functions import triage_rules as T
from ..functions.feature_rules import ENGINES, VULN_TYPES
from ..functions.text import D_SPACE, d_found, duck
from ..operators import rubrics as ru
from . import feature_queries as fq
from . import http_queries as hq
from .claim_queries import PATCH_SQL
from .crash_queries import TRACES, traces_sql
from .registry import query, read
from .triage_queries import coherence_sql

_SMUGGLED = "POST /q HTTP/1.1{0}Host: h.example.org{0}Content-Length: 6{0}Transfer-Encoding: chunked{0}{0}0{0}{0}GPOST / HTTP/1.1"
TEXTS = (
    "CWE-416 use after free in our parser, heap memory is read. " + TRACES[0],
    "CWE-122 with a crash. " + TRACES[1] + " and malloc(4) was 16 bytes",
    "CWE-787 buffer overflow. " + TRACES[2] + " AddressSanitizer: yes; memcpy(a, b, 9) then p->len",
    "CWE-89. SQL injection: the baseline and then the payload; GET /api/x?id=1 and param id. ``` union select 1 ```",
    "CWE-564 SQLi. payload: <insert here>; or 1=1 in POST /login, system(x). placeholder",
    "CWE-1004 nobody knows. alert(1) and document.cookie, reflected in the page, <script>alert(1)</script> at https://h.example.org/a?q=1",
    "Reflected XSS rendered in the response. " + hq.MESSAGES[13] + " <script>",
    "CWE-639 IDOR: alice reads what bob has, /api/orders/17, authorization bypass. " + hq.MESSAGES[3],
    "CWE-327: md5( and AES-128-ECB with a static IV, key:00112233aabb. Forgery is possible. CVSS: 9.8, might allow",
    "Insecure deserialization: pickle.loads of what comes in, ysoserial, remote code execution with /bin/sh",
    "race condition: thread 1 and thread 2, TSAN: yes, pthread_mutex, stat(f) then open(f), double spend",
    "CWE-362 data race. ==5==ERROR: ThreadSanitizer: data race " + TRACES[3],
    "CWE-444 " + _SMUGGLED.format("\r\n"),
    "HTTP desync " + "\n" + _SMUGGLED.format("\n") + " behind nginx/1.18.0",
    "CWE-79 but the heap overflow, double free and segmentation fault say so. Written with ChatGPT.",
    "CWE-999 only.", "We do not have a reproducer, private poc, may not be encrypted.",
    "CWE-119 ```memcpy(a)``` and <script>. or 1=1",
)
_N = len(TEXTS) + 1
_T = "(SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % " + str(_N) + " " + " ".join(f"WHEN {k} THEN {hq._literal(x)}" for k, x in enumerate(TEXTS)) + " ELSE '' END AS t FROM documents)"
#: CWEs above one that no family has.
ANCESTORS = {"1000": ("693", "118"), "564": ("943", "89"), "1004": ("732", "284"), "820": ("662",)}


def _reports(spark, sf_dir):
    more = F.lit("")
    for k, x in enumerate(TEXTS):
        more = F.when(F.col("doc_id") % _N == k, x).otherwise(more)
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more).alias("text"))
    return d.withColumn("cwes", F.regexp_extract_all("text", F.lit(r"(?i)cwe-(\d{1,4})"), F.lit(1)))


_DIRECT = {str(c): name for name, members in R.MEMBERS.items() for c in members}
_KNOWN = _DIRECT | {c: next(_DIRECT[a] for a in up if a in _DIRECT) for c, up in ANCESTORS.items() if c not in _DIRECT and any(a in _DIRECT for a in up)}
_FIRST_TYPE = "CASE " + " ".join(f"WHEN {d_found('t', p, 'i')} THEN '{n}'" for n, p, _ in VULN_TYPES) + " END"
_TYPE_FAMILY = "CASE vuln_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.BY_TYPE.items()) + " END"


def _score(least: int, words) -> str:
    n = " + ".join(f"CASE WHEN {d_found('low', p, 'i')} THEN 1 ELSE 0 END" for p in words)
    return f"CASE WHEN {n} >= {least} THEN {n} ELSE 0 END"


_WORDS = "CASE " + " ".join(f"WHEN k{i} = most THEN '{n}'" for i, n in enumerate(R.KEYWORDS)) + " END"
_CLASSIFIED = rf"""
    t AS {_T},
    c0 AS (SELECT doc_id, t, lower(t) AS low, regexp_extract_all(t, '(?i)cwe-(\d{{1,4}})', 1) AS cwes, {_FIRST_TYPE} AS vuln_type FROM t),
    c1 AS (SELECT *, list_filter(cwes, lambda c: c IN {tuple(_KNOWN)})[1] AS mapped, {", ".join(f"{_score(*w)} AS k{i}" for i, w in enumerate(R.KEYWORDS.values()))} FROM c0),
    c2 AS (SELECT *, greatest({", ".join(f"k{i}" for i in range(len(R.KEYWORDS)))}) AS most, coalesce(mapped, cwes[1]) AS cited, CASE mapped {" ".join(f"WHEN '{c}' THEN '{n}'" for c, n in _KNOWN.items())} END AS cited_family, {_TYPE_FAMILY} AS typed FROM c1),
    c3 AS (SELECT *, coalesce(typed, CASE WHEN most > 0 THEN {_WORDS} END) AS evidence_family, CASE WHEN typed IS NOT NULL THEN 'MEDIUM' WHEN most >= {R.MANY_KEYWORDS} THEN 'MEDIUM' WHEN most > 0 THEN 'LOW' END AS evidence_confidence FROM c2),
    families AS (
        SELECT doc_id, t, low, vuln_type, cited, cited_family, evidence_family, evidence_confidence, coalesce(cited_family, evidence_family, 'FLAT') AS family,
               CASE WHEN mapped IN {tuple(_DIRECT)} THEN 'HIGH' WHEN mapped IS NOT NULL THEN 'MEDIUM' ELSE coalesce(evidence_confidence, 'LOW') END AS confidence FROM c3)"""


@query(f"WITH {_CLASSIFIED} SELECT doc_id, family, confidence, cited, cited_family, evidence_family, evidence_confidence FROM families")
def report_families(spark, sf_dir):
    d = ru.classify(_reports(spark, sf_dir), ancestors=ANCESTORS)
    return d.select("doc_id", "family", "confidence", "cited", "cited_family", "evidence_family", "evidence_confidence")


def _in(families) -> str:
    return "(" + ", ".join(f"'{f}'" for f in families) + ")"


_HITS = " UNION ALL ".join(f"SELECT doc_id, family, '{n}' AS signal, {pts} AS points, {k} AS place FROM seen WHERE family = '{fam}' AND {d_found('shown', p, f)}" for fam, signals in R.SIGNALS.items() for k, (n, p, f, pts) in enumerate(signals))


def _taken(fam: str, signal: str, why: str) -> str:
    return f"(h.family = '{fam}' AND h.signal = '{signal}' AND {why})"


_PATTERN = {(fam, n): (p, f) for fam, signals in R.SIGNALS.items() for n, p, f, _ in signals}
_BODY = [_taken(fam, n, f"slots AND NOT {d_found('without_bodies', *_PATTERN[fam, n])}") for fam, ns in R.BY_BODY.items() for n in ns]
_TAKEN = " OR ".join(
    [_taken(fam, n, "(stripped OR structural)") for fam, ns in R.BY_TRACE.items() for n in ns] + [_taken(fam, n, "request") for fam, ns in R.BY_REQUEST.items() for n in ns] + _BODY
    + [_taken(fam, n, "response") for fam, ns in R.BY_RESPONSE.items() for n in ns] + [_taken(fam, n, f"response AND NOT {d_found('without_answers', *_PATTERN[fam, n])}") for fam, ns in R.BY_RESPONSE_BODY.items() for n in ns])
_ABSENT = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS absence, {pts} AS points, {k} AS place FROM seen WHERE family = '{fam}' AND NOT {d_found('shown', p, 'i')}" for fam, rows in R.ABSENCES.items() for k, (n, p, pts) in enumerate(rows))
_SAID = lambda text: "CASE family " + " ".join(f"WHEN '{fam}' THEN [{', '.join(chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in ps)}] " for fam, ps in R.CONTRADICTIONS.items()) + f"ELSE [] END"
_PROSE = f"lower(regexp_replace(regexp_replace(t, {duck(*R.CODE)}, ' ', 'g'), {duck(*R.HUNK)}, ' ', 'g'))"
_FULL = "CASE family " + " ".join(f"WHEN '{fam}' THEN {float(max(1, int(sum(p for *_, p in s) * R.FULL + 0.5)))}" for fam, s in R.SIGNALS.items()) + " END"
_TOLD = " OR ".join(d_found("u", p, f) for _, p, f in T.DISCLOSURE)
_SPACED = rf"regexp_replace(t, '{D_SPACE}', ' ', 'g')"

_RUBRICS = rf"""{_CLASSIFIED},
    src AS (SELECT doc_id, t FROM families),
    tr AS (SELECT doc_id, stripped, fabricated AS structural FROM ({traces_sql('(SELECT doc_id, t FROM src)')} SELECT * FROM traces)),
    plain_req AS (SELECT doc_id, fake, placeholder_bodies > 0 OR prose_payloads > 0 AS slots FROM ({hq.requests_sql('(SELECT doc_id, t FROM src)')})),
    strict_req AS (SELECT doc_id, fake AS strict_fake FROM ({hq.requests_sql('(SELECT doc_id, t FROM src)', strict=True)})),
    bodies AS (SELECT doc_id, f, CASE WHEN f = '' THEN kept ELSE kept || chr(10) || chr(10) || f END AS without_bodies FROM ({hq.stripped_sql('(SELECT doc_id, t FROM src)')})),
    answers AS (SELECT doc_id, fake AS response_fake, kept AS without_answers FROM ({hq.answered_sql('(SELECT doc_id, t FROM src)')})),
    seen AS (
        SELECT f.*, CASE WHEN family IN {_in(R.BY_REQUEST)} AND b.f <> '' THEN t || chr(10) || chr(10) || b.f ELSE t END AS shown, family IN {_in(R.BY_TRACE)} AND stripped AS stripped, family IN {_in(R.BY_TRACE)} AND structural AS structural,
               CASE WHEN family = '{R.STRICT}' THEN strict_fake ELSE family IN {_in(R.BY_REQUEST)} AND fake END AS request, slots, family IN {_in(R.BY_RESPONSE)} AND response_fake AS response, without_bodies, without_answers
        FROM families f JOIN tr USING (doc_id) JOIN plain_req USING (doc_id) JOIN strict_req USING (doc_id) JOIN bodies b USING (doc_id) JOIN answers USING (doc_id) WHERE family <> 'FLAT'),
    hits AS ({_HITS}),
    marked AS (SELECT h.*, {_TAKEN} AS taken, {" OR ".join(_BODY)} AS by_body FROM hits h JOIN seen USING (doc_id)),
    gold AS (SELECT doc_id, string_agg(CASE WHEN NOT taken THEN signal END, ',' ORDER BY place) AS gold, string_agg(CASE WHEN taken THEN signal END, ',' ORDER BY place) AS revoked, sum(CASE WHEN taken THEN 0 ELSE points END) AS points, bool_or(by_body) AS by_body FROM marked GROUP BY 1),
    absences AS (SELECT doc_id, string_agg(absence, ',' ORDER BY place) AS absent, least({R.ABSENCE_MOST}, sum(points)) AS lacking FROM ({_ABSENT}) GROUP BY 1),
    spoken AS (
        SELECT *, list_filter({_SAID('t')}, lambda p: contains({_PROSE}, p)) AS contradictions, len(list_filter({_SAID('t')}, lambda p: contains(low, p))) > 0 AS contradicts, {_SPACED} AS u FROM seen),
    judged AS (
        SELECT s.doc_id, family, coalesce(gold, '') AS gold, coalesce(revoked, '') AS revoked, coalesce(absent, '') AS absent, array_to_string(contradictions, ',') AS contradictions, coalesce(points, 0) AS points, contradicts,
               request OR response OR coalesce(by_body, false) AS fake, stripped OR structural AS made_up, stripped, {_FULL} AS full_points, CASE WHEN {_TOLD} THEN {T.DISCLOSURE_PENALTY} ELSE 0 END AS told,
               coalesce(lacking, 0) + least({R.CONTRADICTIONS_MOST}, {R.CONTRADICTION} * len(contradictions)) + CASE WHEN stripped OR structural THEN {R.FABRICATED} ELSE 0 END + CASE WHEN request OR response OR coalesce(by_body, false) THEN {R.FABRICATED} ELSE 0 END AS off
        FROM spoken s LEFT JOIN gold USING (doc_id) LEFT JOIN absences USING (doc_id)),
    rated AS (SELECT *, least(100.0, greatest(0.0, least({R.BASE_MOST}, points / full_points * 100) - off - told)) AS raw FROM judged)"""


@query(f"WITH {_RUBRICS} SELECT doc_id, family, gold, revoked, absent, contradictions, CAST(points AS BIGINT) AS points, CAST(off AS BIGINT) AS points_off, fake OR made_up AS fabricated FROM rated")
def family_rubrics(spark, sf_dir):
    d = ru.classify(_reports(spark, sf_dir), ancestors=ANCESTORS).where("family <> 'FLAT'")
    d = ru.judge(d)
    joined = [F.array_join(f"rubric.{c}", ",").alias(c) for c in ("gold", "revoked", "absent", "contradictions")]
    return d.select("doc_id", "family", *joined, "rubric.points", F.col("rubric.off").alias("points_off"), "rubric.fabricated")


_COUNTED = " ".join(f"WHEN '{fam}' THEN {' + '.join(f'CASE WHEN {d_found(chr(116), p, f)} THEN 1 ELSE 0 END' for n, p, f, _ in s if n != R.MEMBERSHIP) }" for fam, s in R.SIGNALS.items())
_MEMBER = " ".join(f"WHEN '{fam}' THEN {' + '.join(f'CASE WHEN {d_found(chr(116), p, f)} THEN 1 ELSE 0 END' for n, p, f, _ in s if n == R.MEMBERSHIP)}" for fam, s in R.SIGNALS.items())
_BASE_SCORE = "CASE base_rule " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.BASES.items()) + " END"
_COHERENT = rf"""
    issues AS ({coherence_sql('(SELECT doc_id, t, family FROM families)')}),
    n AS (
        SELECT f.*, CASE family {_COUNTED} END AS concrete, CASE family {_MEMBER} END AS member, len(list_filter({_SAID('t')}, lambda p: contains(low, p))) AS said, penalty,
               cited IS NULL AND vuln_type IS NOT NULL AS soft, coalesce(evidence_family = family, false) AS same FROM families f JOIN issues USING (doc_id, family)),
    ruled AS (
        SELECT *, CASE WHEN family = 'FLAT' THEN NULL WHEN cited IS NOT NULL AND cited_family <> evidence_family AND evidence_confidence IN ('HIGH', 'MEDIUM') THEN 'OFF_FAMILY_CEILING' WHEN same AND concrete > 0 THEN 'SAME_FAMILY_FLOOR'
            WHEN same AND soft THEN 'SOFT_CITATION' WHEN same THEN 'SAME_FAMILY_NO_CONCRETE_EVIDENCE' WHEN cited IS NOT NULL AND cited_family IS NOT NULL AND evidence_family IS NULL THEN 'CITED_NO_EVIDENCE' WHEN soft THEN 'SOFT_CITATION'
            WHEN cited IS NULL THEN 'FAMILY_DETECTED_NO_CWE' ELSE 'FALLBACK' END AS base_rule FROM n),
    coherent AS (
        SELECT doc_id, family, base_rule, CASE WHEN family <> 'FLAT' THEN CAST(least(100, greatest(0, {_BASE_SCORE} + least({R.GOLD_MOST}, floor((concrete + member) * {R.GOLD_POINTS} + 0.5)) - least({R.OFF_MOST}, {R.OFF} * said) - penalty)) AS BIGINT) END AS family_coherence FROM ruled)"""


@query(f"WITH {_CLASSIFIED}, {_COHERENT} SELECT doc_id, family, coalesce(base_rule, '') AS base_rule, coalesce(family_coherence, 42) AS family_coherence FROM coherent")
def family_coherences(spark, sf_dir):
    d = ru.coherence(ru.classify(_reports(spark, sf_dir).withColumn("coherence", F.lit(42)), ancestors=ANCESTORS))
    return d.select("doc_id", "family", F.coalesce("base_rule", F.lit("")).alias("base_rule"), "family_coherence")


@query(f"WITH {_RUBRICS} SELECT f.doc_id, coalesce(r.fake, false) AS fake_raw_http, coalesce(r.stripped, false) AS stripped_crash_trace FROM families f LEFT JOIN rated r USING (doc_id)")
def evidence_flags(spark, sf_dir):
    d = ru.judge(ru.classify(_reports(spark, sf_dir), ancestors=ANCESTORS))
    return d.select("doc_id", *[F.coalesce(F.col(f"rubric.{c}"), F.lit(False)).alias(c) for c in ("fake_raw_http", "stripped_crash_trace")])



_PLAIN_STAGES, _PLAIN_LAST = fq._stages("g", ENGINES[: ru._PLAIN])
_MORE_STAGES, _MORE_LAST = fq._stages("joined", ENGINES[ru._PLAIN : ru._COMBINED])
_END_STAGES, _END_LAST = fq._stages("ended", ENGINES[ru._COMBINED :])
_KEPT = ("authorship", "substance", "coherence", "claims", "claim_evidence", "strong_evidence")
_BASE = "f0 AS (SELECT doc_id, t FROM src)"
_VAGUE_HITS = " + ".join(f"CASE WHEN contains(lower(u), '{p}') THEN 1 ELSE 0 END" for p, _ in FR.VAGUE)
_VELOCITY = "-5 * (doc_id % 2)"
_REPORTS = rf"""
    WITH {_RUBRICS},
    {_COHERENT},
    plain AS (
        SELECT * FROM (WITH {fq._FEATURES.replace(fq._BASE, _BASE)}, {fq._DERIVED}, g AS (SELECT *, {fq._STRENGTH} AS evidence_strength, CAST({fq._STRONG} AS BIGINT) AS strong_evidence FROM {fq._D}), {_PLAIN_STAGES}
                       SELECT doc_id, {", ".join(_KEPT)} FROM {_PLAIN_LAST})),
    flat AS (
        SELECT doc_id, t, least({FR.VAGUE_MOST}, {FR.VAGUE_POINTS} * ({_VAGUE_HITS})) AS haircut, CASE WHEN {_TOLD} THEN {T.DISCLOSURE_PENALTY} ELSE 0 END AS flat_told, {PATCH_SQL} AS patch
        FROM (SELECT doc_id, t, {_SPACED} AS u FROM src)),
    scored AS (
        SELECT p.doc_id, c.family, p.authorship, p.claims, p.claim_evidence, p.strong_evidence, p.substance AS plain_substance, haircut, patch, base_rule,
               CASE WHEN r.raw IS NOT NULL THEN floor(r.raw * w + p.substance * (1 - w) + 0.5) ELSE least(100, greatest(0, p.substance - haircut - flat_told)) END AS substance, CASE WHEN c.family = 'FLAT' THEN p.coherence ELSE family_coherence END AS coherence
        FROM plain p JOIN coherent c USING (doc_id) JOIN flat USING (doc_id)
        LEFT JOIN (SELECT r.*, CASE WHEN r.raw < {R.LOW} AND p.substance >= {R.PLAIN_HIGH} AND NOT contradicts AND gold <> '' AND NOT fake AND NOT made_up THEN {R.LESS_WEIGHT} ELSE {R.WEIGHT} END AS w FROM rated r JOIN plain p USING (doc_id)) r USING (doc_id)),
    joined AS (SELECT * FROM scored), {_MORE_STAGES},
    ended AS (
        SELECT * EXCLUDE (composite), CAST(least(100, greatest(0, composite + {_VELOCITY} + patch + CASE WHEN family = 'FLAT' AND haircut >= {FR.VAGUE_FROM} THEN {FR.VAGUE_COMPOSITE} ELSE 0 END)) AS BIGINT) AS composite FROM {_MORE_LAST}), {_END_STAGES}"""
_OUT = ("plain_substance", "substance", "coherence", "composite")


@query(f"{_REPORTS} SELECT doc_id, family, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _OUT)}, label, action FROM {_END_LAST}")
def family_reports(spark, sf_dir):
    d = _reports(spark, sf_dir).withColumnRenamed("cwes", "claimed").withColumn("velocity_penalty", F.expr(_VELOCITY))
    d = ru.report(d, ancestors=ANCESTORS)
    return d.select("doc_id", "family", *[F.col(c).cast("bigint").alias(c) for c in _OUT], "label", "action")


@query(f"{_REPORTS} SELECT family, action, count(*) AS documents, CAST(sum(composite) AS BIGINT) AS composites FROM {_END_LAST} GROUP BY 1, 2")
def family_actions(spark, sf_dir):
    return family_reports(spark, sf_dir).groupBy("family", "action").agg(F.count("*").alias("documents"), F.sum("composite").alias("composites"))
