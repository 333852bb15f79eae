"""Queries over text features and the scores made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import feature_rules as R
from ..functions.text import D_SPACE, d_count, d_found, d_phrase_count, d_rnd, duck, rnd
from ..operators import features as fe
from .registry import query, read

_STRIP = lambda x: f"regexp_replace({x}, '^{D_SPACE}|{D_SPACE}$', '', 'g')"
_CV = lambda l, none: f"CASE WHEN len({l}) > 0 AND list_avg({l}) > 0 THEN CASE WHEN len({l}) > 1 THEN list_stddev_pop({l}) ELSE 0.0 END / list_avg({l}) ELSE {float(none)}e0 END"


def _first(x: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {d_found(x, p, 'i')} THEN '{n}'" for n, p, *_ in table) + " END"


_PATH = r"(?:^|[\s(`'\"])((?:[a-zA-Z]:|\.{1,2})?/?(?:[A-Za-z0-9_.\-]+/){1,}[A-Za-z0-9_.\-]+\.[a-zA-Z]{1,6})(?:[\s)`'\":,]|$)"
_HOST = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)"
_FAKE = f"(h IN ({', '.join(repr(h) for h in R.PLACEHOLDER_HOSTS)}) OR regexp_matches(h, {duck(R.PRIVATE_HOST)}))"


def _stages(start: str, stages) -> str:
    out, n = [], start
    for i, stage in enumerate(stages):
        out.append(f"{start}_{i} AS MATERIALIZED (SELECT *, {', '.join(f'{R.sql(f)} AS {k}' for k, f in stage.items())} FROM {n})")
        n = f"{start}_{i}"
    return ", ".join(out), n


_BODY, _LANG = r"```[A-Za-z0-9_+\-]*\n([\s\S]*?)```", r"```([A-Za-z0-9_+\-]*)\n[\s\S]*?```"
_BALANCE = f"CASE WHEN length(b) < 5 THEN 0.5e0 ELSE (1 - least(1e0, abs(len(regexp_extract_all(b, '[(\\[{{]')) - len(regexp_extract_all(b, '[)\\]}}]'))) / greatest(len(regexp_extract_all(b, '[(\\[{{]')), len(regexp_extract_all(b, '[)\\]}}]')), 1))) * 0.7e0 + CASE WHEN {d_found('b', R.CODE_SHAPE)} THEN 0.3e0 ELSE 0e0 END END"
_BASE = "f0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_FEATURES = f"""
    {_BASE},
    f1 AS MATERIALIZED (SELECT *, {", ".join(f"{d_count('t', p, f)} AS {n}" for n, (p, f) in R.COUNTS.items())}, {", ".join(f"{d_found('t', p, f)} AS {n}" for n, (p, f) in R.FLAGS.items())},
        {", ".join(f"{d_phrase_count('t', ps, n in R.WHOLE_WORDS)} AS {n}" for n, ps in R.PHRASES.items())},
        list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP('s')}), lambda s: length(s) > 0) AS sents,
        list_transform(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda s: {_STRIP('s')}), lambda s: length(s) > 0), lambda s: length(s)) AS paras,
        list_slice(regexp_extract_all(lower(t), '\\b[a-z][a-z0-9_]*\\b'), 1, 4000) AS tt, list_slice(regexp_extract_all(lower(t), '\\b[a-z][a-z'']+\\b'), 1, 8000) AS pw,
        regexp_extract_all(t, {duck(R.TERMS)}) AS bm, regexp_split_to_array(t, {duck(R.TERMS)}) AS bp,
        CAST(len(list_distinct(regexp_extract_all(t, {duck(_PATH, 'm')}, 1))) AS BIGINT) AS file_paths,
        list_filter(list_transform(regexp_extract_all(t, {duck(*R.URL)}), lambda u: lower(regexp_extract(u, {duck(_HOST)}, 1))), lambda h: length(h) > 0) AS hosts,
        regexp_extract_all(t, {duck(_LANG)}, 1) AS langs, list_transform(regexp_extract_all(t, {duck(_BODY)}, 1), lambda b: {_BALANCE}) AS syn,
        CAST(len(list_distinct(list_transform(regexp_extract_all(t, {duck(*R.COUNTS['cves'])}), lambda x: upper(x)))) AS BIGINT) AS distinct_cves,
        CAST(len(list_filter(regexp_extract_all(t, {duck(*R.COUNTS['memory_addresses'])}), lambda a: regexp_matches(a, '0{{3,}}$'))) AS BIGINT) AS suspicious_addresses, {_first('t', R.VULN_TYPES)} AS vuln_type
        FROM f0),
    f2 AS (SELECT *, list_filter(list_transform(sents, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: length(w) > 0))), lambda n: n > 0) AS sl, CAST(coalesce(length(sents[1]), 0) AS BIGINT) AS first_sentence,
        CASE WHEN len(tt) > 0 THEN len(list_distinct(tt)) / len(tt) ELSE 0e0 END AS type_token, CASE WHEN len(syn) > 0 THEN list_avg(syn) ELSE 1e0 END AS syntax,
        CASE WHEN len(langs) > 0 THEN len(list_filter(langs, lambda l: l <> '' AND l <> 'text')) / len(langs) ELSE 0e0 END AS language_ratio,
        CASE WHEN len(bm) >= 3 THEN list_transform(list_zip(bm[1:len(bm) - 1], bp[2:len(bm)]), lambda z: length(z[1]) + length(z[2])) ELSE [] END AS gaps,
        CAST(len(list_filter(hosts, lambda h: {_FAKE})) AS BIGINT) AS placeholder_urls, CAST(len(list_filter(hosts, lambda h: NOT {_FAKE})) AS BIGINT) AS real_urls FROM f1),
    fb AS (SELECT doc_id, sum(c * log2(c)) AS xs FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(list_zip(pw[1:len(pw) - 1], pw[2:]), lambda z: z[1] || ' ' || z[2])) AS g FROM f2 WHERE len(pw) > 1) GROUP BY ALL) GROUP BY 1),
    f3 AS (SELECT f2.*, CASE WHEN len(sl) > 0 THEN list_avg(sl) ELSE 0e0 END AS sentence_mean, {_CV('sl', 0.5)} AS sentence_cv, {_CV('paras', 0.5)} AS paragraph_cv, CASE WHEN len(gaps) >= 2 THEN least(100e0, {_CV('gaps', 0.0)} * 50) ELSE 0e0 END AS burstiness,
        CASE WHEN len(pw) < 20 THEN 6e0 ELSE log2(len(pw) - 1) - xs / (len(pw) - 1) END AS entropy,
        CASE WHEN len(pw) < 20 THEN 0e0 ELSE len(list_filter(pw, lambda w: w IN ({", ".join(repr(c) for c in R.CONNECTORS)}))) / len(pw) * 1000 END AS connector_rate FROM f2 LEFT JOIN fb USING (doc_id)),
    f4 AS (SELECT *, CASE WHEN len(pw) < 20 THEN 30e0 ELSE {R.sql(R.clamp(f"{R.clamp('(10.6 - entropy) / (10.6 - 9.0) * 100')} * 0.5 + {R.clamp('(connector_rate - 4) / 8 * 100')} * 0.4 + (1 - syntax) * 40 * 0.1"))} END AS perplexity FROM f3)"""
_DERIVED, _D = _stages("f4", R.DERIVED)
_STRENGTH = " + ".join(R.sql(f"CASE WHEN {t} THEN {b} * {float(m)} ELSE 0.0 END") for _, t, b, m in R.SIGNALS)
_STRONG = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for _, t, _, m in R.SIGNALS if m >= 1.5)
_SCORED, _S = _stages("g", R.ENGINES)
_ALL = f"{_FEATURES}, {_DERIVED}, g AS (SELECT *, {_STRENGTH} AS evidence_strength, CAST({_STRONG} AS BIGINT) AS strong_evidence FROM {_D}), {_SCORED}"

_INTS = [*(n for n in R.COUNTS if n not in ("method_endpoints", "route_endpoints")), *R.PHRASES, "endpoints", "file_paths", "distinct_cves", "suspicious_addresses", "placeholder_urls", "real_urls", "evidence", "completeness"]
_BOOLS = ["executive_summary", "salutation", "poc_claimed", "shell_prompt", "command_output", "real_error", "screenshot", "environment", "depth", "has_steps", "generic_names", "vulnerable_context"]
_FLOATS = ["sentence_mean", "sentence_cv", "paragraph_cv", "type_token", "language_ratio", "burstiness", "technical_density", "claim_evidence", "reproducibility"]


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query(f"WITH {_FEATURES}, {_DERIVED} SELECT doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _INTS)}, {', '.join(_BOOLS)}, {', '.join(f'{d_rnd(c, 6)} AS {c}' for c in _FLOATS)}, vuln_type FROM {_D}")
def text_features(spark, sf_dir):
    d = fe.extract(_documents(spark, sf_dir))
    return d.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in _INTS], *_BOOLS, *[rnd(F.col(c), 6).alias(c) for c in _FLOATS], "vuln_type")


@query(f"WITH {_FEATURES} SELECT doc_id, {d_rnd('entropy', 6)} AS entropy, {d_rnd('connector_rate', 6)} AS connector_rate, {d_rnd('perplexity', 4)} AS perplexity FROM f4")
def bigram_entropy(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    d = _documents(spark, sf_dir).select("doc_id", fe.bigram_perplexity(t, fe.syntax_validity(t)).alias("p"))
    return d.select("doc_id", rnd(F.col("p.entropy"), 6).alias("entropy"), rnd(F.col("p.connector_rate"), 6).alias("connector_rate"), rnd(F.col("p.perplexity"), 4).alias("perplexity"))


_SCORES = ("authorship", "substance", "coherence_gated", "composite", "slop", "label", "authorship_verdict", "substance_verdict", "action")


@query(f"WITH {_ALL} SELECT doc_id, {', '.join(c if c in _SCORES[5:] else f'CAST({c} AS BIGINT) AS {c}' for c in _SCORES)}, {d_rnd('evidence_strength', 4)} AS evidence_strength, strong_evidence FROM {_S}")
def composite_score(spark, sf_dir):
    d = fe.score(_documents(spark, sf_dir))
    return d.select("doc_id", *[F.col(c) if c in _SCORES[5:] else F.col(c).cast("bigint").alias(c) for c in _SCORES], rnd(F.col("evidence_strength"), 4).alias("evidence_strength"), "strong_evidence")


@query(f"WITH {_ALL} SELECT action, count(*) AS documents, min(composite) AS low, max(composite) AS high FROM {_S} GROUP BY 1")
def triage_actions(spark, sf_dir):
    return fe.score(_documents(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("documents"), F.min("composite").alias("low"), F.max("composite").alias("high"))


_UNION = " UNION ALL ".join(f"SELECT '{n}' AS type FROM {_D} WHERE {t}" for n, t, _, _ in R.SIGNALS)


@query(f"WITH {_FEATURES}, {_DERIVED} SELECT type, count(*) AS count FROM ({_UNION}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk_types(spark, sf_dir):
    from ..operators.analytics import top_k

    d = fe.signals(fe.extract(_documents(spark, sf_dir)))
    return top_k(d.select(F.explode("evidence_signals").alias("s")).select(F.col("s.type").alias("t")), "t", name="type")


_POINTS = " + ".join(f"CASE WHEN {d_found('text', p, f)} THEN {w} ELSE 0 END" for w, p, f in R.SPECIFIC.values())


@query(f"SELECT doc_id, CAST(least(100, greatest(0, {_POINTS} - CASE WHEN {d_found('text', *R.UNNAMED_TARGET)} AND NOT {d_found('text', *R.SPECIFIC['project'][1:])} THEN 10 ELSE 0 END)) AS BIGINT) AS claim_specificity FROM documents")
def claim_specificity(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", fe.claim_specificity(F.col("text")).alias("claim_specificity"))


_EV = ", ".join([*(f"{d_found('text', p, f)} AS {n}" for n, (p, f) in R.EVIDENCE.items()), *(f"{d_count('text', p, f)} AS {n}" for n, (p, f) in R.EVIDENCE_COUNTS.items())])


@query(f"WITH e AS (SELECT doc_id, {_EV} FROM documents) SELECT doc_id, CAST({R.sql(R.EVIDENCE_SCORE)} AS BIGINT) AS evidence_quality FROM e")
def evidence_quality(spark, sf_dir):
    return fe.evidence_quality(_documents(spark, sf_dir)).select("doc_id", "evidence_quality")


_CO = f"{_first('text', R.CLASSES)} AS vuln_class, {_first('text', R.LANGUAGES)} AS language, {', '.join(f'{d_found(chr(116) + chr(101) + chr(120) + chr(116), p, f)} AS {n}' for n, (p, f) in R.CONSISTENCY.items())}, {d_count('text', 'CWE-' + chr(92) + 'd+', 'i')} AS cwe_mentions"


@query(rf"WITH e AS (SELECT doc_id, {_CO}, TRY_CAST(nullif(regexp_extract(text, '(?i)CVSS[:\s]*(\d+\.?\d*)', 1), '') AS DOUBLE) AS cvss FROM documents) SELECT doc_id, vuln_class, language, CAST({R.sql(R.CONSISTENCY_SCORE)} AS BIGINT) AS consistency FROM e")
def internal_consistency(spark, sf_dir):
    return fe.consistency(_documents(spark, sf_dir)).select("doc_id", "vuln_class", "language", "consistency")


_HU = ", ".join([*(f"{d_count('text', p, f)} AS {n}" for n, (p, f) in R.HUMAN_COUNTS.items()), *(f"{d_found('text', p, f)} AS {n}" for n, (p, f) in R.HUMAN_FLAGS.items())])
_HP = f"list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length({_STRIP('s')}) > 5), lambda s: len(regexp_split_to_array({_STRIP('s')}, '\\s+')))"


@query(f"""
    WITH e AS (SELECT doc_id, {_HU}, len(regexp_split_to_array(text, '\\s+')) AS h_words, {_HP} AS hp FROM documents), a AS (SELECT *, CASE WHEN len(hp) >= 3 THEN list_avg(hp) <= 15 AND h_words >= 50 ELSE false END AS h_terse FROM e),
    b AS (SELECT *, CAST({R.sql(R.HUMAN_SIGNS)} AS BIGINT) AS human_signs, {R.sql(R.HUMAN_BASE)} AS h_base FROM a)
    SELECT doc_id, human_signs, {R.sql(R.whole(f'h_base * {R.HUMAN_MULTIPLIER}'))} AS human_reduction FROM b""")
def human_indicators(spark, sf_dir):
    return fe.human_signs(_documents(spark, sf_dir)).select("doc_id", "human_signs", "human_reduction")


def _even(l: str, least: int, below: float, w: int) -> str:
    return f"CASE WHEN len({l}) >= {least} AND {_CV(l, 0.0)} < {below}e0 THEN {w} ELSE 0 END"


@query(f"""
    WITH s AS (SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length({_STRIP('s')}) > 0), lambda s: len(regexp_split_to_array({_STRIP('s')}, '\\s+'))) AS a,
        list_transform(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda s: length({_STRIP('s')}) > 20), lambda s: length(s)) AS b, list_transform(regexp_extract_all(text, '(?m)^[\\s]*[-*•]\\s+.+$'), lambda s: length({_STRIP('s')})) AS c FROM documents)
    SELECT doc_id, CAST(least(100, 2 * ({_even('a', 5, 0.25, 12)} + {_even('b', 3, 0.3, 8)} + {_even('c', 4, 0.2, 8)}
        + CASE WHEN {d_count('text', chr(92) + 'b(?:potentially|possibly|might|could|may|appears?' + chr(92) + 's+to|seems?' + chr(92) + 's+to|likely|approximately)' + chr(92) + 'b', 'i')} * 100.0 > len(regexp_extract_all(lower(text), '\\b[a-z]+\\b')) * 2.0 THEN 6 ELSE 0 END
        + CASE WHEN {d_count('text', chr(92) + 'b(?:Furthermore|Moreover|Additionally|In' + chr(92) + 's+addition|Consequently|Therefore|However|Nevertheless)' + chr(92) + 'b', 'i')} * 10 > len(a) * 3 THEN 8 ELSE 0 END)) AS BIGINT) AS spectral FROM s""")
def spectral_score(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", fe.spectral(F.col("text")).alias("spectral"))
