"""Text features and the scores made of them.

Everything is a native expression over one text column: one scan, no shuffle, no
Python. A null text is an empty one. Features come in stages (:func:`extract`),
scores are formulas over them (:func:`score`); the same formulas make the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feature_rules as R
from ..functions.text import array_sum, count, every, found, java, let, mean_cv, pair_runs, phrase_count
from .sections import strip


def derive(df: DataFrame, stages) -> DataFrame:
    """Add stages of formulas, each over the columns of those before."""
    for stage in stages:
        df = df.select("*", *[F.expr(R.sql(f)).alias(n) for n, f in stage.items()])
    return df


def first_of(text: Column, table, else_=None, low: str | Column | None = None) -> Column:
    out = F.lit(else_).cast("string")
    for name, pattern, *_ in reversed(table):
        out = F.when(found(text, pattern, "i", low), name).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 0)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: F.length(p) > 0)


def type_token(text: Column, most: int = 4000) -> Column:
    """Distinct words over words, of the first ``most`` (the feature's definition)."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![A-Za-z0-9_])[a-z][a-z0-9_]*(?![A-Za-z0-9_])"), F.lit(0)), 1, most)
    return let(words, lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0)))


def burstiness(text: Column, low: str | Column | None = None) -> Column:
    """Variation of the distances between technical terms, 0 to 100; needs three.

    A distance is the length of a term and of the text up to the next one, so
    splitting the text at the terms gives all of them without offsets.
    """

    def steps(m: Column) -> Column:
        n = F.size(m)
        gaps = let(F.split(text, java(R.TERMS)), lambda p: F.zip_with(F.slice(m, F.lit(1), n - 1), F.slice(p, F.lit(2), n - 1), lambda m, p: F.length(m) + F.length(p)))
        return F.when(n >= 3, F.least(F.lit(100.0), mean_cv(gaps, 0.0)["cv"] * 50)).otherwise(F.lit(0.0))

    return let(every(text, R.TERMS, low=low), steps)


def bigram_perplexity(text: Column, syntax: Column, most: int = 8000) -> Column:
    """(entropy, connector_rate, perplexity) of the first ``most`` words; fixed values under 20 words."""
    words = F.slice(F.regexp_extract_all(F.lower(text), F.lit(java(r"\b[a-z][a-z']+\b")), F.lit(0)), 1, most)

    def entropy(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        total = pair_runs(pairs)  # c equal pairs add -c/n log2(c/n): the sum of c log2 c suffices
        n = F.greatest(F.size(w) - 1, F.lit(1)).cast("double")
        return F.struct(w.alias("w"), (F.log2(n) - total / n).alias("h"))

    def blend(e: Column) -> Column:
        rate = F.size(F.filter(e["w"], lambda x: x.isin(*R.CONNECTORS))) / F.size(e["w"]) * 1000
        bound = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
        score = bound(bound((10.6 - e["h"]) / (10.6 - 9.0) * 100) * 0.5 + bound((rate - 4) / 8 * 100) * 0.4 + (1 - syntax) * 40 * 0.1)
        few = F.struct(F.lit(6.0).alias("entropy"), F.lit(0.0).alias("connector_rate"), F.lit(30.0).alias("perplexity"))
        return F.when(F.size(e["w"]) < 20, few).otherwise(F.struct(e["h"].alias("entropy"), rate.alias("connector_rate"), score.alias("perplexity")))

    return let(let(words, entropy), blend)


def syntax_validity(text: Column) -> Column:
    """Mean over fenced blocks of bracket balance and code shape; 1 without blocks."""
    bodies = F.regexp_extract_all(text, F.lit(r"```[A-Za-z0-9_+\-]*\n([\s\S]*?)```"), F.lit(1))

    def one(b: Column) -> Column:
        opens, closes = F.regexp_count(b, F.lit(r"[(\[{]")), F.regexp_count(b, F.lit(r"[)\]}]"))
        balance = 1 - F.least(F.lit(1.0), F.abs(opens - closes) / F.greatest(opens, closes, F.lit(1)))
        return F.when(F.length(b) < 5, F.lit(0.5)).otherwise(balance * 0.7 + F.when(b.rlike(java(R.CODE_SHAPE)), 0.3).otherwise(0.0))

    return let(F.transform(bodies, one), lambda s: F.when(F.size(s) > 0, array_sum(s) / F.size(s)).otherwise(F.lit(1.0)))


def file_paths(text: Column) -> Column:
    pattern = r"(?m)(?:^|[\s(`'\"])((?:[a-zA-Z]:|\.{1,2})?/?(?:[A-Za-z0-9_.\-]+/){1,}[A-Za-z0-9_.\-]+\.[a-zA-Z]{1,6})(?=[\s)`'\":,]|$)"
    return F.when(~text.contains("/"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def url_counts(text: Column, low: str | Column | None = None) -> Column:
    """(placeholder, real) URLs by host."""
    hosts = F.transform(every(text, *R.URL, low=low), lambda u: F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    fake = lambda h: h.isin(*R.PLACEHOLDER_HOSTS) | h.rlike(R.PRIVATE_HOST)
    known = lambda hs: F.filter(hs, lambda h: F.length(h) > 0)
    return let(known(hosts), lambda hs: F.struct(F.size(F.filter(hs, fake)).cast("bigint").alias("placeholder"), F.size(F.filter(hs, lambda h: ~fake(h))).cast("bigint").alias("real")))


def extract(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add all features of a text."""
    d = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__low", F.lower("__t"))
    t, low = F.col("__t"), "__low"
    langs = F.regexp_extract_all(t, F.lit(r"```([A-Za-z0-9_+\-]*)\n[\s\S]*?```"), F.lit(1))
    d = d.select(
        "*", *[count(t, p, f, low).alias(n) for n, (p, f) in R.COUNTS.items()], *[found(t, p, f, low).alias(n) for n, (p, f) in R.FLAGS.items()],
        *[phrase_count(t, ps, n in R.WHOLE_WORDS, low).alias(n) for n, ps in R.PHRASES.items()],
        let(sentences(t), lambda s: F.struct(F.coalesce(F.length(F.element_at(F.when(F.size(s) > 0, s), 1)), F.lit(0)).alias("first"), mean_cv(F.transform(s, lambda x: F.size(F.split(x, r"\s+")))).alias("m"))).alias("__s"),
        mean_cv(F.transform(paragraphs(t), F.length))["cv"].alias("paragraph_cv"),
        type_token(t).alias("type_token"), burstiness(t, low).alias("burstiness"), F.size(file_paths(t)).cast("bigint").alias("file_paths"), url_counts(t, low).alias("__u"),
        let(langs, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda l: (l != "") & (l != "text"))) / F.size(x)).otherwise(F.lit(0.0))).alias("language_ratio"),
        F.size(F.array_distinct(F.transform(every(t, *R.COUNTS["cves"], low=low), F.upper))).cast("bigint").alias("distinct_cves"),
        F.array_join(F.slice(F.array_distinct(F.transform(every(t, *R.COUNTS["cwes"], low=low), F.upper)), 1, 5), ",").alias("claimed_cwes"),
        F.size(F.filter(every(t, *R.COUNTS["memory_addresses"], low=low), lambda a: a.rlike("0{3,}$"))).cast("bigint").alias("suspicious_addresses"),
        first_of(t, R.VULN_TYPES, low=low).alias("vuln_type"), syntax_validity(t).alias("syntax"),
    )
    d = d.select(
        "*", F.col("__s.first").cast("bigint").alias("first_sentence"), F.col("__s.m.mean").alias("sentence_mean"), F.col("__s.m.cv").alias("sentence_cv"), F.col("__u.placeholder").alias("placeholder_urls"), F.col("__u.real").alias("real_urls"),
        bigram_perplexity(t, F.col("syntax")).alias("__p"),
    )
    d = d.select("*", F.col("__p.entropy").alias("entropy"), F.col("__p.connector_rate").alias("connector_rate"), F.col("__p.perplexity").alias("perplexity")).drop("__t", "__low", "__s", "__u", "__p")
    return derive(d, R.DERIVED)


def signals(d: DataFrame) -> DataFrame:
    """Add ``evidence_signals`` (type, strength), their sum ``evidence_strength`` and ``strong_evidence`` (of multiplier 1.5 and more)."""
    one = [F.expr(R.sql(f"CASE WHEN {test} THEN {base} * {float(m)} END")) for _, test, base, m in R.SIGNALS]
    parts = [F.when(x.isNotNull(), F.struct(F.lit(n).alias("type"), x.alias("strength"), F.lit(m).alias("multiplier"))) for x, (n, _, _, m) in zip(one, R.SIGNALS)]
    d = d.withColumn("evidence_signals", F.array_compact(F.array(*parts)))
    return d.withColumn("evidence_strength", F.aggregate("evidence_signals", F.lit(0.0), lambda a, s: a + s["strength"])).withColumn(
        "strong_evidence", F.size(F.filter("evidence_signals", lambda s: s["multiplier"] >= 1.5)).cast("bigint")
    )


def score(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Features, evidence, the three engines, composite, label and triage action."""
    return derive(signals(extract(df, text_col)), R.ENGINES)


def claim_specificity(text: Column) -> Column:
    points = sum((F.when(found(text, p, f), w).otherwise(0) for w, p, f in R.SPECIFIC.values()), F.lit(0))
    unnamed = found(text, *R.UNNAMED_TARGET) & ~found(text, *R.SPECIFIC["project"][1:])
    return F.least(F.lit(100), F.greatest(F.lit(0), points - F.when(unnamed, 10).otherwise(0))).cast("bigint")


def evidence_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    d = df.select("*", *[found(text_col, p, f).alias(n) for n, (p, f) in R.EVIDENCE.items()], *[count(text_col, p, f).alias(n) for n, (p, f) in R.EVIDENCE_COUNTS.items()])
    return derive(d, ({"evidence_quality": f"CAST({R.EVIDENCE_SCORE} AS BIGINT)"},)).drop(*R.EVIDENCE, *R.EVIDENCE_COUNTS)


def consistency(df: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.col(text_col)
    cvss = F.expr(f"try_cast(nullif(regexp_extract({text_col}, '(?i)CVSS[:\\\\s]*(\\\\d+\\\\.?\\\\d*)', 1), '') AS double)")
    d = df.select("*", first_of(t, R.CLASSES).alias("vuln_class"), first_of(t, R.LANGUAGES).alias("language"), *[found(t, p, f).alias(n) for n, (p, f) in R.CONSISTENCY.items()], count(t, r"CWE-\d+", "i").alias("cwe_mentions"), cvss.alias("cvss"))
    return derive(d, ({"consistency": f"CAST({R.CONSISTENCY_SCORE} AS BIGINT)"},)).drop(*R.CONSISTENCY, "cwe_mentions", "cvss")


def human_signs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``human_signs`` and ``human_reduction``."""
    t = F.col(text_col)
    parts = F.filter(F.split(t, "[.!?]+"), lambda s: F.length(strip(s)) > 5)
    mean = let(F.transform(parts, lambda s: F.size(F.split(strip(s), r"\s+"))), lambda n: F.when(F.size(n) >= 3, array_sum(n) / F.size(n)))
    words = F.size(F.split(t, r"\s+")).cast("bigint")
    d = df.select("*", *[count(t, p, f).alias(n) for n, (p, f) in R.HUMAN_COUNTS.items()], *[found(t, p, f).alias(n) for n, (p, f) in R.HUMAN_FLAGS.items()], words.alias("h_words"), mean.alias("h_mean"))
    stages = ({"h_terse": "coalesce(h_mean <= 15, false) AND h_words >= 50"}, {"human_signs": f"CAST({R.HUMAN_SIGNS} AS BIGINT)", "h_base": R.HUMAN_BASE}, {"human_reduction": R.whole(f"h_base * {R.HUMAN_MULTIPLIER}")})
    return derive(d, stages).drop(*R.HUMAN_COUNTS, *R.HUMAN_FLAGS, "h_words", "h_mean", "h_terse", "h_base")


def spectral(text: Column) -> Column:
    """Uniformity of sentences, paragraphs and lists, hedges and connectors: 0 to 100."""
    sent = F.filter(F.split(text, "[.!?]+"), lambda s: F.length(strip(s)) > 0)
    para = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(strip(p)) > 20)
    items = every(text, r"^[\s]*[-*•]\s+.+$", "m")
    even = lambda lengths, least, below, w: let(lengths, lambda n: F.when((F.size(n) >= least) & (mean_cv(n, 0.0)["cv"] < below), w).otherwise(0))
    hedges = count(text, r"\b(?:potentially|possibly|might|could|may|appears?\s+to|seems?\s+to|likely|approximately)\b", "i")
    words = F.regexp_count(F.lower(text), F.lit(r"(?<![A-Za-z0-9_])[a-z]+(?![A-Za-z0-9_])"))
    links = count(text, r"\b(?:Furthermore|Moreover|Additionally|In\s+addition|Consequently|Therefore|However|Nevertheless)\b", "i")
    total = (
        even(F.transform(sent, lambda s: F.size(F.split(strip(s), r"\s+"))), 5, 0.25, 12) + even(F.transform(para, F.length), 3, 0.3, 8)
        + F.when(hedges * 100.0 > words * 2.0, 6).otherwise(0) + even(F.transform(items, lambda i: F.length(strip(i))), 4, 0.2, 8)
        + F.when(links * 10 > F.size(sent) * 3, 8).otherwise(0)
    )
    return F.least(F.lit(100), total * 2).cast("bigint")
