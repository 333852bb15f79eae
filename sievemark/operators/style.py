"""Style of a text in numbers, templates it follows, and a simple slop heuristic: native expressions, a null text is an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import style_rules as R
from ..functions.text import array_sum, count, found, let, mean_cv, pair_runs
from .features import derive
from .sections import strip


def _pair_entropy(words: Column) -> Column:
    """Entropy of neighbouring words over the most it could be; 1 where that is 0."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    total = pair_runs(pairs)
    return F.when(n > 1, (F.log2(n) - total / n) / F.log2(n)).otherwise(F.lit(1.0))


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the numbers that the scores here are formulas of."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__low", F.lower("__t"))
    t, low = F.col("__t"), "__low"
    words = F.split(t, r"\s+")
    long_ = F.filter(F.split(F.col(low), r"\s+"), lambda w: F.length(w) > 2)
    sentences = F.transform(F.filter(F.transform(F.split(t, "[.!?]+"), strip), lambda s: F.length(s) > 10), lambda s: F.size(F.split(s, r"\s+")))
    d = df.withColumns({
        "__s": let(sentences, lambda n: F.struct(F.size(n).alias("n"), mean_cv(n, 0.0)["cv"].alias("cv"), F.when(F.size(n) > 0, array_sum(n) / F.size(n)).otherwise(F.lit(0.0)).alias("mean"))),
        "__w": let(long_, lambda w: F.struct(F.size(w).alias("n"), _pair_entropy(w).alias("h"))),
        "words": F.size(words).cast("bigint"), "distinct_words": F.size(F.array_distinct(F.split(F.col(low), r"\s+"))).cast("bigint"),
        "passives": count(t, *R.PASSIVE[0], low) + count(t, *R.PASSIVE[1], low), "contractions": count(t, *R.CONTRACTIONS, low), "formal": count(t, *R.FORMAL, low),
        "paragraphs": F.size(F.filter(F.split(t, "\n\n+"), lambda p: F.length(strip(p)) > 0)).cast("bigint"),
        "stock": let(F.col(low), lambda x: F.size(F.filter(F.array(*[F.lit(p) for p in R.STOCK_PHRASES]), lambda p: x.contains(p)))).cast("bigint"),
        **{n: found(t, p, f, low) for n, (p, f) in R.STRUCTURE.items()},
    })
    return d.withColumns({"long_sentences": F.col("__s.n"), "sentence_cv": F.col("__s.cv"), "sentence_words": F.col("__s.mean"), "long_words": F.col("__w.n"), "pair_entropy": F.col("__w.h")}).drop("__t", "__low", "__s", "__w")


def statistical(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``statistical``, 0 to 100, and its parts."""
    return derive(measures(df, text_col), R.STATISTICAL)


def heuristic(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``slop_points``, ``quality_points`` and ``slop_tier``."""
    return derive(measures(df, text_col), R.HEURISTIC)


def templates(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``template_names`` that a text follows and ``template``: five times their weights, at most 100."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    hits = {n: sum((F.when(found(t, p, "i"), 1).otherwise(0) for p in patterns), F.lit(0)) >= least for n, (_, least, patterns) in R.TEMPLATES.items()}
    followed = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(n).alias("name"), F.lit(R.TEMPLATES[n][0]).alias("weight"))) for n, hit in hits.items()]))
    weight = F.aggregate("template_names", F.lit(0), lambda a, x: a + x["weight"])
    d = df.withColumn("template_names", followed).withColumn("template", F.least(F.lit(100), 5 * weight).cast("bigint"))
    return d.withColumn("template_names", F.transform("template_names", lambda x: x["name"]))
