"""Queries of style in numbers, templates and the slop heuristic. Some documents get lines of our own after theirs, as none follows a template."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import style_rules as R
from ..functions.text import D_SPACE, d_count, d_found, d_rnd, rnd
from ..operators import style as st
from .feature_queries import _CV, _stages
from .registry import query, read

TEXTS = (
    "Dear team, I hope this report finds you well. Best regards",
    "Vulnerability type: x\nSeverity: high\nCVSS score: 9\nDescription: y\nImpact: z\nRemediation: w\nSteps to reproduce: none",
    "The npm audit shows vulnerable dependencies, as per OWASP. We recommend to ensure proper authentication.",
    "Executive summary: a\nDetailed description: b\nSecurity audit report\nFinding #3: sqli with ' OR 1=1 and Expected behavior: none",
    "It is important to note that we delve into this multifaceted tapestry; in conclusion it is not what was expected and it was done. " * 6,
    "It's crucial to see version 2.4 at /src/a.c, function: f. It should return 1 but it crashes. `x` has a network impact; a PoC is there.",
    "The data is checked and was used. The item was found and is kept. The file was taken and is used. The part is made and was seen. The work is done and was shown. " * 5,
)
_N = len(TEXTS) + 2
_CASE = "CASE " + " ".join("WHEN doc_id % {} = {} THEN '{}'".format(_N, k, x.replace("'", "''")) for k, x in enumerate(TEXTS)) + " ELSE '' END"
_T = f"(SELECT doc_id, coalesce(text, '') || chr(10) || {_CASE} AS t FROM documents)"


def _marked(spark, sf_dir):
    more = F.lit("")
    for k, x in enumerate(TEXTS):
        more = F.when(F.col("doc_id") % _N == k, x).otherwise(more)
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more).alias("text"))


_STRIP = f"regexp_replace(s, '^{D_SPACE}|{D_SPACE}$', '', 'g')"
_MEASURES = f"""
    m0 AS (SELECT doc_id, t, regexp_split_to_array(lower(t), '\\s+') AS ws, list_transform(list_filter(list_transform(regexp_split_to_array(t, '[.!?]+'), lambda s: {_STRIP}), lambda s: length(s) > 10), lambda s: len(regexp_split_to_array(s, '\\s+'))) AS sl
        FROM {_T}),
    m1 AS (SELECT *, list_filter(ws, lambda w: length(w) > 2) AS lw FROM m0),
    mb AS (SELECT doc_id, sum(c * log2(c)) AS xs FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(list_zip(lw[1:len(lw) - 1], lw[2:]), lambda z: z[1] || ' ' || z[2])) AS g FROM m1 WHERE len(lw) > 1) GROUP BY ALL) GROUP BY 1),
    m AS (SELECT m1.doc_id, len(ws) AS words, len(list_distinct(ws)) AS distinct_words, len(sl) AS long_sentences, {_CV('sl', 0.0)} AS sentence_cv, CASE WHEN len(sl) > 0 THEN list_avg(sl) ELSE 0e0 END AS sentence_words, len(lw) AS long_words,
        CASE WHEN len(lw) > 2 THEN (log2(len(lw) - 1) - xs / (len(lw) - 1)) / log2(len(lw) - 1) ELSE 1e0 END AS pair_entropy, {d_count('t', *R.PASSIVE[0])} + {d_count('t', *R.PASSIVE[1])} AS passives,
        {d_count('t', *R.CONTRACTIONS)} AS contractions, {d_count('t', *R.FORMAL)} AS formal, len(list_filter(regexp_split_to_array(t, '\\n\\n+'), lambda s: length({_STRIP}) > 0)) AS paragraphs,
        {" + ".join("CASE WHEN contains(lower(t), '" + p.replace("'", "''") + "') THEN 1 ELSE 0 END" for p in R.STOCK_PHRASES)} AS stock, {", ".join(f"{d_found('t', p, f)} AS {n}" for n, (p, f) in R.STRUCTURE.items())} FROM m1 LEFT JOIN mb USING (doc_id))"""
_STAT, _STAT_LAST = _stages("m", R.STATISTICAL)
_HEUR, _HEUR_LAST = _stages("m", R.HEURISTIC)


@query(f"WITH {_MEASURES}, {_STAT} SELECT doc_id, {d_rnd('sentence_cv', 6)} AS sentence_cv, {d_rnd('passive_ratio', 6)} AS passive_ratio, {d_rnd('pair_entropy', 6)} AS pair_entropy, statistical FROM {_STAT_LAST}")
def statistical_style(spark, sf_dir):
    d = st.statistical(_marked(spark, sf_dir))
    return d.select("doc_id", *[rnd(F.col(c), 6).alias(c) for c in ("sentence_cv", "passive_ratio", "pair_entropy")], "statistical")


@query(f"WITH {_MEASURES}, {_HEUR} SELECT doc_id, slop_points, quality_points, slop_tier FROM {_HEUR_LAST}")
def slop_heuristic(spark, sf_dir):
    return st.heuristic(_marked(spark, sf_dir)).select("doc_id", "slop_points", "quality_points", "slop_tier")


_HITS = {n: f"({' + '.join(f'CASE WHEN {d_found('t', p, 'i')} THEN 1 ELSE 0 END' for p in ps)} >= {least})" for n, (_, least, ps) in R.TEMPLATES.items()}


@query(f"""
    SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _HITS.items())}) AS templates,
        CAST(least(100, 5 * ({" + ".join(f"CASE WHEN {h} THEN {R.TEMPLATES[n][0]} ELSE 0 END" for n, h in _HITS.items())})) AS BIGINT) AS template FROM {_T}""")
def template_matches(spark, sf_dir):
    return st.templates(_marked(spark, sf_dir)).select("doc_id", F.array_join("template_names", ",").alias("templates"), "template")
