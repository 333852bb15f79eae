"""Queries of gaps, advice and feedback, of projects and code named, and of impossible answers. The documents have little of it, so most get a text of our own after theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import advice_rules as R
from ..functions import excerpt_rules as E
from ..functions.text import D_SPACE, d_count, d_found, duck
from ..operators import advice as ad
from ..operators import claims as cl
from ..operators import excerpts as ex
from ..operators import triage as tr
from . import claim_queries as cq
from . import triage_queries as tq
from .registry import query, read

TEXTS = (
    "Dear team, a critical XSS at endpoint /api/x in src/a.js. See CVE-2024-12345 and http://target.com/login",
    "# Impact\nStep 1: run curl -v on nginx 1.25.3, then step 2.\n```bash\ncurl -H 'Host: a' http://real.host/\n```\nThe risk is a data leak; a fix is in 1.25.4, before 1.25.4 all are affected. Environment: Linux, default config, remote.",
    "A payload shows the IDOR of an access control in version 2.0; the package and the library are old. CVE-2020-11111 CVE-2021-22222 CVE-2022-33333 are chained to an RCE. To whom it may concern.",
    "The dependency is a module without any number. An internal service listens. High severity, the JWT is weak.",
    "==77==ERROR: AddressSanitizer: x 0x602000000000 0x603000000000\n#0 0x1 in f\n#1 0x2 in f\n#2 0x3 in f\nWe follow responsible disclosure. Run exploit.py, the XSS leads to remote code execution by an overflow in lib/http.c line 12.",
    "See https://github.com/curl/curl.git, github.com/a-b/c.d, gitlab.com/e/f and gitlab.com/a-b/c.d; curl 7.1; nodejs and node v1.2; npm install left-pad, require('@x/y'), pip install requests; import os; from flask import Flask; "
    "import numpy; import numpy; Redis is here, and far from any number of it are many words, so that eighty letters lie in between, which they do by now. Version 3 of Django.",
    "The function parse_it(x) and the handler `on_data`( fail in read_all(y) at main(z). void do_work(int a) { } In src/core/io.c:88 and (lib/b/c.py) and http/x/y.js, from Foo::bar(q): copy() => x",
    "```http\nHEAD /x HTTP/1.1\nHost: a\nSet-Cookie: a=b\n\nHTTP/1.1 200 Not Found\nContent-Length: 0\nCookie: x\n\nbody text here\n```",
    "```\nHTTP/1.1 204 No Content\r\n\r\nsome body text\r\n```\nand\n```\nHTTP/1.1 200  OK \nContent-Length: 1024\n\n\n```\nand\n```\nHTTP/1.0 302 Found\nContent-Length: 30\nContent-Length: 400\nOrigin: x\n\nshort body\n```",
    "```\nGET /a HTTP/1.1\nHTTP/1.1 404 Gone\nno header\n\nPOST /b HTTP/1.1\nCookie: fine\n\nHTTP/1.1 200 ok\nContent-Length: 10\n\n0123456789\n```\nHTTP/1.1 200 Not Found\n",
    "```graphql\n{\"data\": null}\n```\n```\n{\"data\": null}\n```\n```json\n{\"data\": {}, \"errors\": []}\n```\n```json\nnot json\n```",
    "A GraphQL answer:\n```json\n{\"data\": {\"a\": 1, \"b\": null, \"c d\": [2]}, \"errors\": [{\"path\": [\"a\"], \"extensions\": {\"code\": \"sql_injection_done\"}}, {\"path\": [\"zz\", 0]}, {\"path\": [\"b\"]}, {\"path\": [0]}, 3, null]}\n```",
    "Answer of graphql:\n```\n{\"data\": {\"a\": null}, \"errors\": [{\"path\": [\"a\"], \"extensions\": {\"code\": \"FORBIDDEN\"}}]}\n```\n```\n{\"errors\": [{\"message\": \"x\", \"locations\": []}, {\"extensions\": {\"code\": \"RCE_DONE\"}}]}\n```\n```\n{\"errors\": [{\"message\": \"EXPLOIT\"}]}\n```",
)
_N = len(TEXTS) + 2
_CASE = "CASE " + " ".join(f"WHEN doc_id % {_N} = {k} THEN " + "'" + x.replace("'", "''") + "'" for k, x in enumerate(TEXTS)) + " ELSE '' END"
_T = f"(SELECT doc_id, coalesce(text, '') || chr(10) || {_CASE} AS t FROM documents)"


def _marked(spark, sf_dir):
    more = F.lit("")
    for k, x in enumerate(TEXTS):
        more = F.when(F.col("doc_id") % _N == k, x).otherwise(more)
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more).alias("text"))


_trim = lambda s: f"regexp_replace({s}, '^{D_SPACE}|{D_SPACE}$', '', 'g')"
_all = lambda rule, group=0: f"regexp_extract_all(t, {duck(*rule)}, {group})"
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
_once = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_names = lambda rules: "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{n}' END" for n, test in rules) + ")"
_sum = lambda rules: " + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for test in rules)

#: Inputs of the advice: evidence and class come from the text; what a look-up of its references gave is dealt by id.
_VERIFIED, _NOT_FOUND = "CASE WHEN doc_id % 3 <> 0 THEN {} % 4 END", "CASE WHEN doc_id % 3 <> 0 THEN {} % 3 END"
_ADVICE = f"""
    i AS (SELECT doc_id, t, slop, CASE WHEN s >= 0.4e0 THEN 0.9e0 WHEN s >= 0.2e0 THEN 0.6e0 WHEN s > 0 THEN 0.3e0 ELSE 0e0 END AS confidence, s > 0 AS known_class, CASE WHEN placeholder > 0 THEN 1 ELSE 0 END AS placeholders,
            fabricated >= 12 AS fabricated, {_VERIFIED.format('doc_id // 3')} AS verified, {_NOT_FOUND.format('doc_id // 12')} AS not_found
        FROM (SELECT doc_id, t, list_max([{tq._SHARES}]).s AS s FROM {_T})
        JOIN (WITH {cq._HAL.replace(cq._T, _T)} SELECT doc_id, least(100, 2 * ({cq._SUM})) AS slop FROM c) USING (doc_id) JOIN (WITH {cq._FACTS.replace(cq._T, _T)} SELECT doc_id, placeholder, fabricated FROM w) USING (doc_id)),
    f AS (SELECT *, {", ".join(f"{d_found('t', *rule)} AS {n}" for n, rule in R.FLAGS.items())}, {", ".join(f"{d_count('t', *rule)} AS {n}" for n, rule in R.COUNTS.items())}, len(regexp_split_to_array(t, '\\s+')) AS words FROM i),
    g AS (SELECT *, {_sum(test for _, s, test in R.GAPS if s == "critical")} AS critical, {_sum(test for _, s, test in R.GAPS if s == "important")} AS important_gaps FROM f)"""
_BY_SEVERITY = [(c, test) for s in R.SEVERITIES for c, of, test in R.GAPS if of == s]
_SAID = _names([(k, test) for k, _, _, test in sorted(R.FEEDBACK, key=lambda f: f[2])])


@query(f"""WITH {_ADVICE} SELECT doc_id, {_names(_BY_SEVERITY)} AS gaps, {_names(R.AREAS)} AS areas, {_names(R.STRENGTHS)} AS strengths, CASE WHEN {_SAID} = '' THEN '{R.NOTHING[0]}' ELSE {_SAID} END AS feedback,
    CAST({R.CLARITY} AS BIGINT) AS clarity, {R.ACTIONABILITY} AS actionability FROM g""")
def report_advice(spark, sf_dir):
    d, t = cl.hallucination(_marked(spark, sf_dir)), F.col("text")
    d = d.select(
        "doc_id", "text", (100 - F.col("hallucination")).alias("slop"), tr.vuln_class(t)["confidence"].alias("confidence"), (cl.placeholder_weight(t) > 0).cast("bigint").alias("placeholders"),
        (cl.fabricated_output(t) >= 12).alias("fabricated"), F.expr(_VERIFIED.format("doc_id div 3")).alias("verified"), F.expr(_NOT_FOUND.format("doc_id div 12")).alias("not_found"),
    )
    joined = lambda c, field=None: F.array_join(F.transform(c, lambda x: x[field]) if field else c, ",").alias(c)
    return ad.advise(d).select("doc_id", joined("gaps", "category"), joined("areas"), joined("strengths"), joined("feedback", "kind"), "clarity", "actionability")


@query(f"""WITH {_ADVICE}, n AS (UNPIVOT (SELECT doc_id, {", ".join(f"CAST({test} AS INT) AS {c}" for c, _, test in R.GAPS)} FROM g) ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME gap VALUE has)
    SELECT gap, count(*) AS documents FROM n WHERE has = 1 GROUP BY 1""")
def gap_counts(spark, sf_dir):
    gaps = report_advice(spark, sf_dir).select(F.explode(F.split("gaps", ",")).alias("gap"))
    return gaps.where("gap <> ''").groupBy("gap").agg(F.count("*").alias("documents"))


def _known() -> str:
    out, seen = [], {}
    for name, slug in R.PROJECTS.items():
        here = " AND ".join([d_found("t", rf"\b{name}\b", "i"), *[f"NOT {d_found('t', rf'{chr(92)}b{o}{chr(92)}b', 'i')}" for o in seen.get(slug, ())], f"NOT list_contains(slugs, '{slug}')"])
        seen.setdefault(slug, []).append(name)
        near = f"regexp_extract(t, {duck(rf'[{chr(92)}s{chr(92)}S]{{0,{R.NEAR}}}?{chr(92)}b{name}{chr(92)}b[{chr(92)}s{chr(92)}S]{{0,{R.NEAR}}}', 'i')})"
        out.append(f"CASE WHEN {here} THEN '{name}|{slug}|' || CASE WHEN {d_found(near, *R.VERSION_NEAR)} THEN 'github_url' ELSE 'known_project' END END")
    return "list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL)"


_ITEM = lambda source: f"lambda s: string_split(s, '/')[2] || '|' || s || '|{source}'"
_PACKAGE = lambda x, spared, source: f"list_transform(list_filter({_once(x)}, lambda p: length(p) BETWEEN 2 AND 100 AND lower(p) NOT IN {_in(spared)}), lambda p: p || '|' || p || '|{source}')"


def projects_sql(source: str) -> str:
    """(doc_id, projects) over a source of (doc_id, t)."""
    return f"""
    WITH a AS (SELECT doc_id, t, list_transform({_all(R.GITHUB, 1)}, lambda s: regexp_replace(s, '\\.git$', '')) AS h0, list_transform({_all(R.GITLAB, 1)}, lambda s: regexp_replace(s, '\\.git$', '')) AS l0, {_all(R.NPM, 1)} AS n0, {_all(R.PYPI, 1)} AS p0 FROM {source}),
    b AS (SELECT *, {_once('h0')} AS hub, list_filter({_once('l0')}, lambda s: NOT list_contains(h0, s)) AS lab FROM a), c AS (SELECT *, list_concat(hub, lab) AS slugs FROM b),
    d AS (SELECT doc_id, list_concat(list_concat(list_transform(hub, {_ITEM('github_url')}), list_transform(lab, {_ITEM('gitlab_url')})), list_concat({_known()}, list_concat({_PACKAGE('n0', [''], 'npm_package')}, {_PACKAGE('p0', R.PYTHON_STDLIB, 'pypi_package')}))) AS p FROM c)
    SELECT doc_id, array_to_string(p[1:{R.MOST_PROJECTS}], ',') AS projects FROM d"""


@query(projects_sql(_T))
def named_projects(spark, sf_dir):
    d = _marked(spark, sf_dir).select("doc_id", ad.projects(F.col("text")).alias("p"))
    return d.select("doc_id", F.array_join(F.transform("p", lambda p: F.concat_ws("|", p["name"], p["slug"], p["source"])), ",").alias("projects"))


def code_sql(source: str) -> str:
    """(doc_id, functions, paths) over a source of (doc_id, t)."""
    return f"""
    WITH a AS (SELECT doc_id, list_filter(list_concat(list_concat({_all(R.FUNCTIONS[0], 1)}, {_all(R.FUNCTIONS[1], 1)}), {_all(R.FUNCTIONS[2], 1)}), lambda f: lower(f) NOT IN {_in(R.COMMON_NAMES)} AND length(f) <= {R.LONGEST_FUNCTION}) AS f0,
        list_filter({_all(R.PATHS, 1)}, lambda p: length(p) <= {R.LONGEST_PATH} AND NOT starts_with(p, 'http')) AS p0 FROM {source})
    SELECT doc_id, array_to_string({_once('f0')}[1:{R.MOST_NAMES}], ',') AS functions, array_to_string({_once('p0')}[1:{R.MOST_NAMES}], ',') AS paths FROM a"""


@query(code_sql(_T))
def code_references(spark, sf_dir):
    d = _marked(spark, sf_dir).select("doc_id", ad.code_references(F.col("text")).alias("c"))
    return d.select("doc_id", F.array_join("c.functions", ",").alias("functions"), F.array_join("c.paths", ",").alias("paths"))


_RIGHT = "(" + ", ".join("'" + f"{c} {p}".replace("'", "''") + "'" for c, ps in E.REASONS.items() for p in ps) + ")"
_HAS = lambda side, names: ", ".join(f"CASE WHEN list_contains(hn, '{n}') THEN '{side}{n}' END" for n in names)
def blocks_sql(source: str) -> str:
    """CTEs over a source of (doc_id, t) up to ``k2``: its fenced blocks."""
    return f"""
    k0 AS (SELECT doc_id, {_all(E.FENCE)} AS bl, regexp_split_to_array(t, {duck(*E.FENCE)}) AS pc FROM {source} WHERE contains(t, '```')), k1 AS (SELECT *, unnest(range(1, len(bl) + 1)) AS i FROM k0),
    k2 AS (SELECT doc_id, i, regexp_extract(bl[i], {duck(*E.FENCE)}, 1) AS label, regexp_extract(bl[i], {duck(*E.FENCE)}, 2) AS body,
        contains(lower(right(array_to_string(list_transform(range(1, i + 1), lambda j: pc[j] || CASE WHEN j < i THEN bl[j] ELSE '' END), ''), {E.PROSE})), 'graphql') AS said FROM k1)"""


_BLOCKS = blocks_sql(_T)
_HTTP = f"""
    h0 AS (SELECT doc_id, i, string_split(regexp_replace(translate(body, chr(1), ' '), {duck(*E.START)}, '\\1' || chr(1) || '\\2', 'g'), chr(1))[2:] AS p FROM k2), h1 AS (SELECT doc_id, i, p, unnest(range(1, len(p) + 1)) AS k FROM h0),
    h2 AS (SELECT doc_id, i, k, regexp_extract(p[k], '^[^\\n]*\\n') AS line, substr(p[k], length(regexp_extract(p[k], '^[^\\n]*\\n')) + 1) AS tail FROM h1),
    h3 AS (SELECT *, CASE WHEN {d_found('tail', *E.BLANK_FIRST)} THEN '' WHEN {d_found('tail', *E.HEAD_AND_BODY)} THEN regexp_extract(tail, {duck(*E.HEAD_AND_BODY)}, 1) ELSE tail END AS head,
        CASE WHEN {d_found('tail', *E.BLANK_FIRST)} THEN regexp_replace(tail, {duck(*E.BLANK_FIRST)}, '') WHEN {d_found('tail', *E.HEAD_AND_BODY)} THEN regexp_extract(tail, {duck(*E.HEAD_AND_BODY)}, 2) ELSE '' END AS body FROM h2),
    h4 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(head, '\\r?\\n'), lambda s: {_trim('s')}), lambda s: {d_found('s', *E.HEADER)}) AS hs, regexp_extract(line, {duck(*E.STATUS_LINE)}, 1) AS code, regexp_extract(line, {duck(*E.STATUS_LINE)}, 2) AS phrase FROM h3),
    h5 AS (SELECT *, list_transform(hs, lambda s: lower(regexp_extract(s, {duck(*E.HEADER)}, 1))) AS hn, length({_trim('body')}) AS size, CASE WHEN code = '' THEN regexp_extract(line, {duck(*E.METHOD)}, 1) ELSE '' END AS method,
        regexp_replace(lower({_trim('phrase')}), '\\s+', ' ', 'g') AS said, regexp_extract(list_filter(hs, lambda s: lower(regexp_extract(s, {duck(*E.HEADER)}, 1)) = 'content-length')[-1], {duck(*E.HEADER)}, 2) AS cl FROM h4),
    h6 AS (SELECT *, CASE WHEN regexp_full_match(cl, '\\d+') THEN CAST(cl AS DOUBLE) END AS declared, lag(method) OVER (PARTITION BY doc_id, i ORDER BY k) AS before FROM h5),
    h7 AS (SELECT doc_id, unnest(CASE WHEN code <> '' THEN [
        CASE WHEN code IN {_in(E.REASONS)} AND said <> '' AND code || ' ' || said NOT IN {_RIGHT} THEN 'status_' || code || '_with_wrong_reason_phrase' END,
        CASE WHEN regexp_matches(code, '^(?:204|304|1..)$') AND size >= {E.BODY} THEN 'status_' || code || '_must_have_no_body' END,
        CASE WHEN declared = 0 AND size >= {E.BODY} THEN 'content_length_zero_but_body_present' WHEN declared >= {E.DECLARED} AND size = 0 THEN 'content_length_declared_but_body_empty'
            WHEN declared > {E.DECLARED_FROM} AND size > 0 AND abs(declared - length(body)) > greatest({E.OFF}, declared * {E.OFF_SHARE}e0) THEN 'content_length_disagrees_with_body' END,
        {_HAS('response_carries_request_only_', E.REQUEST_ONLY)}, {", ".join(f"CASE WHEN before = '{n}' AND size >= {E.BODY} THEN 'response_to_{n}_must_have_no_body' END" for n in E.NO_BODY_TO)}]
        ELSE [{_HAS('request_carries_response_only_', E.RESPONSE_ONLY)}] END) AS name FROM h6)"""
_EXT = "upper(json_extract_string(e, '$.extensions.code'))"
_GRAPHQL = f"""
    g0 AS (SELECT doc_id, label, said, TRY_CAST(body AS JSON) AS j FROM k2), g1 AS (SELECT *, list_contains(json_keys(j), 'data') AS hd, list_contains(json_keys(j), 'errors') AS he FROM g0 WHERE json_type(j) = 'OBJECT'),
    g2 AS (SELECT *, json_extract(j, '$.data') AS dt, CASE WHEN json_type(j, '$.errors') = 'ARRAY' THEN json_extract(j, '$.errors[*]') END AS es FROM g1 WHERE hd OR he),
    g3 AS (SELECT *, CASE WHEN json_type(dt) = 'OBJECT' THEN json_keys(dt) END AS dk FROM g2 WHERE lower(label) IN {_in(E.GRAPHQL_LABELS)} OR (hd AND (he OR said))
        OR len(list_filter(es, lambda e: coalesce(json_type(e, '$.locations') = 'ARRAY', false) OR coalesce(json_type(e, '$.path') = 'ARRAY', false) OR coalesce(json_type(e, '$.extensions') = 'OBJECT', false))) > 0),
    g4 AS (SELECT *, unnest(es) AS e FROM g3), g5 AS (SELECT *, CASE WHEN json_type(e, '$.path[0]') = 'VARCHAR' THEN json_extract_string(e, '$.path[0]') END AS n FROM g4),
    g6 AS (SELECT doc_id, 'data_null_with_no_errors' AS name FROM g3 WHERE hd AND NOT he AND json_type(j, '$.data') = 'NULL' UNION ALL SELECT doc_id, 'empty_errors_array' FROM g3 WHERE len(es) = 0
        UNION ALL SELECT doc_id, 'error_path_references_unknown_field' FROM g5 WHERE NOT list_contains(dk, n) UNION ALL SELECT doc_id, 'errored_field_not_null' FROM g5 WHERE list_contains(dk, n) AND json_type(dt, '$."' || n || '"') <> 'NULL'
        UNION ALL SELECT doc_id, 'fabricated_extensions_code' FROM g5 WHERE json_type(e, '$.extensions.code') = 'VARCHAR' AND ({" OR ".join(f"contains({_EXT}, '{c}')" for c in E.FABRICATED_CODES)}))"""


@query(f"""
    WITH {_BLOCKS}, {_HTTP}, {_GRAPHQL}, p AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS http, count(*) AS n FROM (SELECT DISTINCT * FROM h7 WHERE name IS NOT NULL) GROUP BY 1), q AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS graphql, count(*) AS m FROM (SELECT DISTINCT * FROM g6) GROUP BY 1)
    SELECT d.doc_id, coalesce(http, '') AS http, coalesce(graphql, '') AS graphql, CAST({E.MARKER_WEIGHT} * (coalesce(n, 0) + coalesce(m, 0)) AS BIGINT) AS weight FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""")
def impossible_excerpts(spark, sf_dir):
    d, t = _marked(spark, sf_dir), F.col("text")
    d = d.select("doc_id", ex.impossible_http(t).alias("h"), ex.impossible_graphql(t).alias("g"))
    return d.select("doc_id", F.array_join("h", ",").alias("http"), F.array_join("g", ",").alias("graphql"), (E.MARKER_WEIGHT * (F.size("h") + F.size("g"))).cast("bigint").alias("weight"))
