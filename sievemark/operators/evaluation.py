"""Scores against labels: feedback reports, confusion, calibration, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, rnd
from .analytics import count_if, feedback_band, rate

#: Expected rating of each feedback band. Fixed values.
EXPECTED = (("0-20", 4.5), ("21-40", 3.5), ("41-60", 3.0), ("61-80", 3.5), ("81-100", 4.0))


def holdout(key: Column, share: int = 5) -> Column:
    """A fifth of all rows, by a hash that other engines have too: the first 8 hex digits of MD5 modulo ``share``."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % share == 0


def feedback_summary(df: DataFrame, rating: str, helpful: str) -> DataFrame:
    return df.agg(F.count("*").alias("feedback"), (F.floor(F.avg(rating) * 100 + 0.5) / 100).alias("avg_rating"), count_if(F.col(helpful)).alias("helpful"), rate(count_if(F.col(helpful)) * 100, F.count("*"), 1).alias("helpful_pct"))


def rating_histogram(df: DataFrame, rating: str) -> DataFrame:
    """Rows (rating, count) for 1 to 5, zeros included."""
    counts = df.agg(*[count_if(F.col(rating) == r).alias(f"r{r}") for r in range(1, 6)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rating"), F.col(f"r{r}").alias("count")) for r in range(1, 6)])))


def outliers(feedback: DataFrame, scored: DataFrame, k: int = 50) -> DataFrame:
    """Feedback that contradicts the score, worst first; a top-k report.

    ``feedback`` has (report_id, feedback_id, rating, helpful), ``scored`` (report_id, score).
    """
    j = feedback.join(scored, "report_id")
    odd = ((F.col("rating") <= 2) & (F.col("score") < 30)) | ((F.col("rating") <= 2) & (F.col("score") > 70)) | ~F.col("helpful")
    gap = F.abs(F.col("score") - F.col("rating") * 20)
    return j.where(odd).select("feedback_id", "report_id", "rating", "score", gap.alias("gap")).orderBy(F.desc("gap"), "feedback_id").limit(k)


def score_by_rating(joined: DataFrame) -> DataFrame:
    """Per feedback band: rows, mean rating and helpful share, with the smallest score to order by."""
    return joined.groupBy(feedback_band(F.col("score")).alias("bucket")).agg(
        F.count("*").alias("feedback"), (F.floor(F.avg("rating") * 100 + 0.5) / 100).alias("avg_rating"), rate(count_if(F.col("helpful")) * 100, F.count("*"), 1).alias("helpful_pct"), F.min("score").alias("min_score")
    )


def signal_precision(df: DataFrame, signals: str, truth: Column, least: int = 5) -> DataFrame:
    """Per signal type: rows it fires on (once a row), true ones, precision where it fires at least ``least`` times."""
    hit = df.select(F.explode(F.array_distinct(signals)).alias("signal"), truth.alias("t"))
    n = F.count("*")
    return hit.groupBy("signal").agg(n.alias("fires"), count_if(F.col("t")).alias("correct"), F.when(n >= least, rate(count_if(F.col("t")), n, 3)).alias("precision"))


def confusion(df: DataFrame, truth: Column, predicted: Column, by: Column | None = None, places: int = 3) -> DataFrame:
    """tp, fp, tn, fn with precision, recall, F1 and accuracy, per group ``grp`` if ``by`` is given."""
    t = df.select(truth.alias("t"), predicted.alias("p"), *([by.alias("grp")] if by is not None else []))
    g = t.groupBy("grp") if by is not None else t.groupBy()
    c = g.agg(*[count_if(F.col("t").eqNullSafe(a) & F.col("p").eqNullSafe(b)).alias(n) for n, a, b in (("tp", True, True), ("fp", False, True), ("tn", False, False), ("fn", True, False))])
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("precision", rate(tp, tp + fp, places)).withColumn("recall", rate(tp, tp + fn, places))
    return c.withColumn("f1", rate(tp * 2, tp * 2 + fp + fn, places)).withColumn("accuracy", rate(tp + tn, tp + fp + tn + fn, places))


def holdout_gap(evaluated: DataFrame, least: int = 20, limit: float = 0.1) -> DataFrame:
    """In-sample minus held-out F1 and accuracy of :func:`confusion` by group true/false, and whether one is over ``limit``."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    pick = lambda c, held: F.max(F.when(F.col("grp") == held, c))
    one = evaluated.agg(*[pick(F.col(m), h).alias(f"{m}_{k}") for m in ("f1", "accuracy") for h, k in ((False, "in"), (True, "out"))], pick(n, True).alias("held_out_rows"))
    f1, acc = rnd(F.col("f1_in") - F.col("f1_out"), 3), rnd(F.col("accuracy_in") - F.col("accuracy_out"), 3)
    enough = F.col("held_out_rows") >= least
    return one.select(f1.alias("f1_gap"), acc.alias("accuracy_gap"), F.coalesce(F.col("held_out_rows"), F.lit(0)).alias("held_out_rows"), F.coalesce(enough & ((f1 > limit) | (acc > limit)), F.lit(False)).alias("drifted"))


def calibration(joined: DataFrame, least: int = 5) -> DataFrame:
    """Per feedback band: rows, mean rating, helpful share, deviation from the expected rating and what it says about the scores."""
    per = joined.groupBy(feedback_band(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"), count_if(F.col("helpful")).alias("helpful_n"))
    spine = joined.sparkSession.createDataFrame(EXPECTED, "bucket string, expected double")
    f = spine.join(F.broadcast(per), "bucket", "left").fillna(0, ["n", "ratings", "helpful_n"])
    avg = rate(F.col("ratings"), F.col("n"), 2)
    dev = avg - F.col("expected")
    good, slop = F.col("bucket").isin("0-20", "21-40"), F.col("bucket").isin("61-80", "81-100")
    signal = (
        F.when(F.col("n") < least, "insufficient-data").when(F.abs(dev) <= 0.5, "accurate").when(good & (dev < -0.5), "under-scoring")
        .when(slop & (dev < -0.5), "over-scoring").when(good & (dev > 0.5), "accurate").when(dev < -0.5, "over-scoring").otherwise("under-scoring")
    )
    return f.select("bucket", F.col("n").alias("feedback"), avg.alias("avg_rating"), rate(F.col("helpful_n") * 100, F.col("n"), 1).alias("helpful_pct"), (F.floor(dev * 100 + 0.5) / 100).alias("deviation"), signal.alias("signal"))


def health(calibrated: DataFrame) -> DataFrame:
    bad = count_if(F.col("signal").isin("over-scoring", "under-scoring"))
    return calibrated.agg(bad.alias("problems"), F.when(bad == 0, "good").when(bad <= 1, "needs-attention").otherwise("needs-tuning").alias("health"))


def change_guard(current: DataFrame, proposed: DataFrame, limit: float = 0.2) -> DataFrame:
    """Parameters (name, value) whose relative change reaches ``limit``; a change from 0 counts as whole."""
    j = current.select("name", F.col("value").alias("old")).join(proposed.select("name", F.col("value").alias("new")), "name")
    rel = F.when(F.col("old") != 0, F.abs(F.col("new") - F.col("old")) / F.abs("old")).when(F.col("new") != 0, 1.0).otherwise(0.0)
    return j.select("name", "old", "new", rel.alias("relative_change"), (rel >= limit).alias("blocked"))


def brier(df: DataFrame, p: Column, truth: Column) -> DataFrame:
    return df.agg(rnd(F.avg(F.pow(p - F.when(truth, 1.0).otherwise(0.0), 2)), 6).alias("brier"), F.count("*").alias("rows"))


def ece(df: DataFrame, p: Column, truth: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error: gap of mean probability and share of true rows per bin, weighted by rows."""
    b = df.select(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin"), p.alias("p"), F.when(truth, 1.0).otherwise(0.0).alias("t"))
    per = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("t").alias("acc"))
    return per.agg(rnd(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"), F.count("*").alias("bins"))


def class_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Per class: support, recall, precision, F1 (of a class table, so small whatever the rows)."""
    m = df.groupBy(truth.alias("t"), predicted.alias("p")).agg(F.count("*").alias("n"))
    actual = m.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = m.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    j = actual.join(said, "label", "left").fillna(0, ["said"])
    return j.select("label", "support", rate(F.col("tp"), F.col("support"), 4).alias("recall"), rate(F.col("tp"), F.col("said"), 4).alias("precision"), rate(F.col("tp") * 2, F.col("support") + F.col("said"), 4).alias("f1"))


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(rnd(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("classes"))


def nearest_rank(df: DataFrame, value: str, by: str, p: float) -> DataFrame:
    """Nearest-rank percentile per group: the smallest value with at least ``p`` of the rows up to it."""
    per = df.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(value)
    run = per.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    return run.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * p))).groupBy(by).agg(F.min(value).alias("value"))


def language_agreement(df: DataFrame, language: str, group: str, level: Column) -> DataFrame:
    """Share of (group, language) mean levels within one tier of the group's first language (by name).

    Rows are averaged per group and language first, so the self-join is over that small table.
    """
    per = df.groupBy(group, language).agg(js_round(F.avg(level)).alias("level"))
    first = per.groupBy(group).agg(F.min_by("level", language).alias("base"), F.min(language).alias("base_language"))
    j = per.join(first, group).where(F.col(language) != F.col("base_language"))
    return j.groupBy(language).agg(rate(count_if(F.abs(F.col("level") - F.col("base")) <= 1), F.count("*"), 3).alias("agreement"), F.count("*").alias("compared"))
