"""Queries of crash traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crash_rules as R
from ..functions.text import d_found, duck
from ..functions import claim_rules as C
from ..operators import claims, crash
from . import advice_queries as aq
from . import claim_queries as cq
from .registry import query, read

_PAIRS = " ".join(["fa"] * 16)
_LEGEND = "Addressable: 00\nHeap left redzone: fa\nFreed heap region: fd"
#: The documents hold no traces: most get one of these behind their text.
TRACES = (
    "==4711==ERROR: AddressSanitizer: heap-use-after-free on address 0x602000000010\nREAD of size 8 at 0x602000000010 thread T0\n#0 0x4f2a11 in parse_header src/parse.c:418\n#1 0x4f2b90 in read_all src/read.c:77\n"
    "#2 0x4f31c3 in main src/main.c:12\nfreed by thread T0 here:\n#0 0x4a1b2c in __interceptor_free\n8-byte region [0x602000000010,0x602000000018)",
    "[memcheck] frame 0: <symbol stripped> in libserver\n[memcheck] frame 1: <unknown> in libserver\n[memcheck] frame 2: libserver at 0xZZZZ\n[memcheck] frame 3: do_work(int) work.c:3",
    "#0 0x7f in alpha+0x100 libx\n#1 0x7f in beta+0x0 libx\n#3 0x7f in gamma+0x2000 libx\nthread T5 was here",
    "region size: 0x100\n==0==ERROR\nfreed by thread T7000",
    "in text a+0x1 does not count\n#0 0x1 in one+0x1 (x)\n#1 0x2 in two+0x00200000 (x)\n#2 0x3 in three+0x5f (x)",
    "==12==ERROR: AddressSanitizer: heap-use-after-free\nREAD of size 16 at 0x60 thread T1\n2-byte region [0x10,0x12)\nfreed by thread T2\npreviously allocated by thread T3",
    "RAX: 0x1000 RBX: 0x20000 rcx=0x41414141 RDX 0x41414141 RSI: 0x41414141 RDI: 0x3000\nx10 = 0x7ffd1234abcd PSTATE: 0x60000000",
    "00400000-00452000 r-xp 00000000 fd:00\n7f00a1000000-7f00a1021000 rw-p\n7f00a1020000-7f00a1031000 rw-p",
    "1000-2000 r--p 0\n55f4a1c89123-55f4a1c8a456 r-xp 0",
    f"==9==ERROR: AddressSanitizer: heap-use-after-free on address\nShadow bytes around the buggy address:\n  0x0c047fff8000: {_PAIRS}\n\n=>0x0c047fff8010: fa fa[fa]{_PAIRS[8:]}\n{_LEGEND}",
    f"==9==ERROR: AddressSanitizer: stack-buffer-overflow\nShadow bytes around the buggy address:\n=>0x0c047fff8010: fa [f1] fa fa\n{_LEGEND}",
    "Shadow bytes around the buggy address: none shown",
    "Name: x\nVmPeak:    65536 kB\nVmSize:\t 1024 kB\nVmRSS: 4232 kB\nVmStk: 132 kB",
    "WRITE of size 4 at 0xab thread T1\nfreed by thread T2\n==77==\nregion size: 4096",
    "    #0 0x1 foo::bar::baz lib\n    #1 0x2 ?? (??:0)\n    #2 0x3 unknown function\n#3 bare library",
)
_K = len(TRACES) + 2
_T = "(SELECT doc_id, coalesce(text, '') || CASE doc_id % " + str(_K) + " " + " ".join(f"WHEN {k} THEN chr(10) || '{t}'" for k, t in enumerate(TRACES)) + " ELSE '' END AS t FROM documents)"


def traced(spark, sf_dir):
    line = F.lit("")
    for k, t in enumerate(TRACES):
        line = F.when(F.col("doc_id") % _K == k, "\n" + t).otherwise(line)
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), line).alias("text"))


def _all(text: str, rule: tuple, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {duck(*rule)}, {group})"


def _bare(digits: str) -> str:
    return f"CASE WHEN ltrim(lower({digits}), '0') = '' THEN '0' ELSE ltrim(lower({digits}), '0') END"


def _bug_bytes(phrase: str) -> str:
    return "CASE " + " ".join(f"WHEN {d_found(phrase, p, 'i')} THEN [{', '.join(repr(b) for b in held)}]" for p, held in R.BUG_BYTES) + " END"


_PLACEHOLDER, _GOOD = f"({d_found('f', *R.PLACEHOLDER)} OR {d_found('f', *R.NOT_HEX)})", f"({d_found('f', *R.SOURCE)} OR {d_found('f', *R.SYMBOL)})"
_UNRANGED = rf"regexp_extract(list_filter({_all('t', R.REGION, 0)}, lambda m: right(m, 1) <> '[')[1], '(\d+)$', 1)"
_ROW = duck(*R.SHADOW_ROW)

def traces_sql(source: str) -> str:
    """CTEs over a source of (doc_id, t) up to ``markers`` and ``traces``: rows of markers, each from the rows that it is about: frames, numbers, registers, mappings, grid rows, threads."""
    return rf"""
    WITH t AS {source},
    frames AS (SELECT doc_id, unnest(l) AS f, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_all('t', R.FRAME, 0)} AS l FROM t)),
    counts AS (
        SELECT doc_id, count(*) AS frames, count(*) FILTER (WHERE {_PLACEHOLDER}) AS placeholders, count(*) FILTER (WHERE NOT {_PLACEHOLDER} AND {_GOOD}) AS good FROM frames GROUP BY 1),
    numbered AS (
        SELECT doc_id, i, TRY_CAST(regexp_extract(f, {duck(*R.NUMBER)}, 1) || regexp_extract(f, {duck(*R.NUMBER)}, 2) AS DOUBLE) AS n FROM frames),
    offsets AS (SELECT doc_id, lower(unnest({_all('f', R.OFFSET)})) AS o FROM frames),
    in_offsets AS (SELECT doc_id, unnest({_all('f', R.IN_OFFSET)}) AS o FROM frames),
    pids AS (SELECT doc_id, CAST(unnest({_all('t', R.PID)}) AS DOUBLE) AS n FROM t),
    threads AS (SELECT doc_id, CAST(unnest({_all('t', R.THREAD)}) AS DOUBLE) AS n FROM t),
    roles AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS role, {_bare('d')} AS thread FROM (SELECT doc_id, unnest({_all('t', rule)}) AS d FROM t)" for k, rule in enumerate(R.ROLES))}),
    by_role AS (SELECT doc_id, role, count(DISTINCT thread) AS threads, min(thread) AS one FROM roles GROUP BY 1, 2),
    regions AS (
        SELECT doc_id, t, CAST(nullif(coalesce(nullif(regexp_extract(t, {duck(*R.BRACKETED_REGION)}, 1), ''), {_UNRANGED}), '') AS DOUBLE) AS region, CAST(nullif({_UNRANGED}, '') AS DOUBLE) AS unranged,
               CAST(nullif(regexp_extract(t, {duck(*R.ACCESS)}, 1), '') AS DOUBLE) AS access FROM t),
    registers AS (SELECT doc_id, {_bare('h')} AS v FROM (SELECT doc_id, unnest({_all('t', R.REGISTER)}) AS h FROM t)),
    repeated AS (SELECT doc_id, v, count(*) AS n, count(*) * CASE WHEN {d_found('v', *R.ROUND_REGISTER)} OR (length(v) > 1 AND count(*) >= {R.REPEATED}) THEN 1 ELSE 0 END AS odd FROM registers GROUP BY 1, 2),
    mappings AS (
        SELECT doc_id, lpad(lower(regexp_replace(split_part(m, '-', 1), '^0x', '')), 16, '0') AS a, lpad(lower(regexp_replace(split_part(m, '-', 2), '^0x', '')), 16, '0') AS b
        FROM (SELECT doc_id, unnest({_all('t', R.MAPPING)}) AS m FROM t)),
    mapped AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a, b) AS was, count(*) OVER (PARTITION BY doc_id) AS n FROM mappings),
    status AS (SELECT doc_id, TRY_CAST(unnest({_all('t', R.STATUS)}) AS BIGINT) AS v FROM t),
    grids AS (
        SELECT doc_id, t, list_filter(string_split(replace(regexp_extract(t, {duck(*R.SHADOW)}, 1), chr(13) || chr(10), chr(10)), chr(10)), lambda s: regexp_replace(s, '\s', '', 'g') <> '') AS lines FROM t WHERE {d_found('t', *R.SHADOW)}),
    numbered_lines AS (SELECT doc_id, unnest(lines) AS s, unnest(range(1, len(lines) + 1)) AS i FROM grids),
    ends AS (SELECT g.doc_id, g.t, coalesce(min(i) FILTER (WHERE NOT regexp_matches(s, {_ROW})), 1000000000) AS stop FROM grids g LEFT JOIN numbered_lines l USING (doc_id) GROUP BY 1, 2),
    grid AS (
        SELECT e.doc_id, e.t, l.i, l.s, regexp_extract(s, {_ROW}, 1) = '=>' AS marked, list_filter(string_split_regex(translate(regexp_extract(s, {_ROW}, 2), '[]', '  '), '\s+'), lambda x: x <> '') AS pairs
        FROM ends e LEFT JOIN numbered_lines l ON l.doc_id = e.doc_id AND l.i < e.stop),
    bytes AS (
        SELECT doc_id, t, arg_min(lower(regexp_extract(s, {duck(*R.MARKED_BYTE)}, 1)), i) AS byte FROM grid WHERE marked AND {d_found('s', *R.MARKED_BYTE)} GROUP BY 1, 2),
    classes AS (
        SELECT doc_id, byte, coalesce({_bug_bytes(f"regexp_extract(t, {duck(*R.BUG_CLASS)}, 1)")}, {_bug_bytes(f"split_part(regexp_extract(t, {duck(*R.BUG_LINE)}), chr(10), 1)")}) AS expected FROM bytes),
    markers AS (
        SELECT doc_id, 'round_function_offsets' AS marker FROM offsets WHERE {d_found('o', *R.ROUND_OFFSET)} GROUP BY doc_id HAVING count(*) >= {R.FEWEST_OFFSETS}
        UNION ALL SELECT DISTINCT a.doc_id, 'frame_numbering_gaps' FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE b.n > a.n + 1
        UNION ALL SELECT doc_id, 'thread_id_inconsistency' FROM t WHERE {d_found('t', *R.THREAD)} AND NOT {d_found('t', *R.PID)}
        UNION ALL SELECT doc_id, 'round_heap_region_size' FROM regions WHERE {d_found('t', *R.HEX_REGION)} OR unranged IN {R.TEXTBOOK_REGIONS}
        UNION ALL SELECT doc_id, 'implausible_function_offset' FROM in_offsets WHERE {d_found(f"ltrim(lower(o), '0')", *R.ODD_OFFSET)} GROUP BY doc_id HAVING count(*) >= {R.FEWEST_OFFSETS}
        UNION ALL SELECT DISTINCT doc_id, 'implausible_thread_id' FROM (SELECT doc_id FROM pids WHERE n = 0 OR n > {R.MOST_PID} UNION ALL SELECT doc_id FROM threads WHERE n > {R.MOST_THREAD})
        UNION ALL SELECT doc_id, 'region_size_vs_access_size' FROM regions WHERE region = 0 OR (access > 0 AND access > region AND {d_found('t', *R.WITHIN_CHUNK)})
        UNION ALL SELECT doc_id, 'fabricated_register_state' FROM repeated GROUP BY doc_id HAVING sum(n) >= {R.FEWEST_REGISTERS} AND sum(odd) >= {R.FEWEST_REGISTERS} AND 2 * sum(odd) >= sum(n)
        UNION ALL SELECT DISTINCT doc_id, 'fabricated_memory_map' FROM mapped WHERE n >= 2 AND (b <= a OR a < '{R.LOWEST_MAPPING}' OR right(a, 3) <> '000' OR right(b, 3) <> '000' OR a < was)
        UNION ALL SELECT doc_id, 'malformed_shadow_bytes' FROM grid GROUP BY doc_id, t
            HAVING count(i) = 0 OR count(*) FILTER (WHERE len(pairs) <> {R.ROW_WIDTH} OR len(list_filter(pairs, lambda x: NOT {d_found('x', *R.PAIR)})) > 0) > 0 OR count(*) FILTER (WHERE marked) = 0 OR NOT {d_found('t', *R.LEGEND)}
        UNION ALL SELECT doc_id, 'shadow_byte_class_mismatch' FROM classes WHERE NOT list_contains(expected, byte)
        UNION ALL SELECT doc_id, 'thread_id_mismatch' FROM roles GROUP BY doc_id HAVING count(DISTINCT thread) >= {R.FEWEST_THREADS}
        UNION ALL SELECT doc_id, 'thread_role_no_overlap' FROM by_role GROUP BY doc_id HAVING count(*) >= 2 AND max(role) > 0 AND max(threads) = 1 AND count(DISTINCT one) = count(*)
        UNION ALL SELECT doc_id, 'fabricated_proc_status' FROM status GROUP BY doc_id HAVING count(*) >= {R.FEWEST_STATUS} AND count(*) FILTER (WHERE v >= {R.LEAST_POWER} AND v & (v - 1) = 0) >= {R.FEWEST_POWERS}),
    marked AS (SELECT doc_id, string_agg(marker, ',' ORDER BY marker) AS markers, count(*) AS n FROM markers GROUP BY 1),
    traces AS (
        SELECT t.doc_id, coalesce(frames, 0) AS frames, coalesce(good, 0) AS good, coalesce(placeholders, 0) AS placeholders,
               coalesce(frames >= {R.FEWEST_FRAMES} AND (100 * good < {R.RESOLVED} * frames OR 2 * placeholders >= frames), false) AS stripped, coalesce(markers, '') AS markers, coalesce(n, 0) >= {R.FABRICATED} AS fabricated
        FROM t LEFT JOIN counts USING (doc_id) LEFT JOIN marked USING (doc_id))"""


@query(f"{traces_sql(_T)} SELECT * FROM traces")
def crash_traces(spark, sf_dir):
    trace = crash.evaluate(F.col("text"))
    out = traced(spark, sf_dir).withColumn("x", trace)
    return out.select("doc_id", "x.frames", "x.good", "x.placeholders", "x.stripped", F.array_join(F.array_sort("x.markers"), ",").alias("markers"), "x.fabricated")


@query(f"{traces_sql(_T)} SELECT marker, count(*) AS texts, count(*) FILTER (WHERE fabricated) AS fabricated FROM markers JOIN traces USING (doc_id) GROUP BY 1")
def crash_marker_counts(spark, sf_dir):
    out = traced(spark, sf_dir).select(crash.evaluate(F.col("text")).alias("x")).select(F.explode("x.markers").alias("marker"), "x.fabricated")
    return out.groupBy("marker").agg(F.count("*").alias("texts"), F.sum(F.col("fabricated").cast("bigint")).alias("fabricated"))


#: Excerpts of answers between the traces.
_EXCERPTS = (
    "```\nHTTP/1.1 404 OK\nContent-Length: 0\n\nnot so empty\n```\n#0 a.c\n#2 b.c", '```graphql\n{"data": null}\n```\nthread T2000', "```json\n{\"errors\": []}\n```\nclean",
)
_M = len(TRACES) + len(_EXCERPTS) + 1
_BOTH = "(SELECT doc_id, coalesce(text, '') || chr(10) || CASE doc_id % " + str(_M) + " " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate((*TRACES, *_EXCERPTS))) + " ELSE '' END AS t FROM documents)"
_W = f"CASE WHEN coalesce(x.n, 0) = 1 THEN {C.ONE_MARKER} ELSE {C.MARKER} * coalesce(x.n, 0) END"
_MORE = ("structural_fabrication", _W), ("impossible_http_response", f"{C.EXCERPT_MARKER} * coalesce(h.n, 0)"), ("impossible_graphql_response", f"{C.EXCERPT_MARKER} * coalesce(g.n, 0)")
_TOTAL = f"({cq._SUM} + {' + '.join(w for _, w in _MORE)})"
_SIGNALS = "concat_ws(',', " + ", ".join(f"CASE WHEN {w} > 0 THEN '{n}' END" for n, w in _MORE) + f", nullif({cq._NAMES}, ''))"


@query(f"""
    WITH src AS {_BOTH}, {cq.hallucination_sql('(SELECT * FROM src)')}, {aq.blocks_sql('(SELECT * FROM src)')}, {aq._HTTP}, {aq._GRAPHQL},
    x AS (SELECT doc_id, count(*) AS n FROM ({traces_sql('(SELECT * FROM src)')} SELECT doc_id, marker FROM markers) GROUP BY 1),
    h AS (SELECT doc_id, count(DISTINCT name) AS n FROM h7 WHERE name IS NOT NULL GROUP BY 1), g AS (SELECT doc_id, count(DISTINCT name) AS n FROM g6 GROUP BY 1)
    SELECT c.doc_id, {_SIGNALS} AS signals, CAST({_TOTAL} AS BIGINT) AS signal_weight, CAST(greatest(0, 100 - 2 * {_TOTAL}) AS BIGINT) AS hallucination
    FROM c LEFT JOIN x USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)""")
def hallucination_whole(spark, sf_dir):
    line = F.lit("")
    for k, t in enumerate((*TRACES, *_EXCERPTS)):
        line = F.when(F.col("doc_id") % _M == k, t).otherwise(line)
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))
    return claims.hallucination_whole(d).select("doc_id", F.array_join(F.transform("signals", lambda s: s["type"]), ",").alias("signals"), "signal_weight", "hallucination")
