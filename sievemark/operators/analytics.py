"""Aggregates over scored rows: totals, distributions, trends, cohorts, latency, uptime and incidents.

Every function takes columns by name and ``now`` where time matters. All are
grouped aggregates with partial sums on the map side; windows run over the
aggregates (days, bins, stages), not over the rows, except where a function says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, rnd, seconds

#: Three schemes of five score bands. Fixed values.
STATS_BANDS = ((0, 20), (21, 35), (36, 55), (56, 75), (76, 100))
FEEDBACK_CUTS = (20, 40, 60, 80)
TIER_CUTS = ((80, "Slop"), (60, "Likely Slop"), (40, "Questionable"), (20, "Likely Human"))
BIN_EDGES = (50, 100, 200, 400, 800, 1500, 3000, 5000, 10000, 20000)


def tier(score: Column) -> Column:
    """Five tiers, cut at 20, 40, 60 and 80, each cut belonging to the upper one."""
    out = F.lit("Clean")
    for cut, name in reversed(TIER_CUTS):
        out = F.when(score >= cut, name).otherwise(out)
    return out


def stats_band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in STATS_BANDS:
        out = F.when(score.between(low, high), f"{low}-{high}").otherwise(out)
    return out


def feedback_band(score: Column) -> Column:
    out = F.lit("81-100")
    for low, high in reversed(list(zip((0, *[c + 1 for c in FEEDBACK_CUTS]), FEEDBACK_CUTS))):
        out = F.when(score <= high, f"{low}-{high}").otherwise(out)
    return out


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def rate(part: Column, whole: Column, places: int) -> Column:
    """part / whole rounded half up, 0 for an empty whole."""
    k = 10**places
    return F.when(whole > 0, F.floor(part.cast("double") / whole * k + 0.5) / k).otherwise(F.lit(0.0))


def totals(df: DataFrame, score: str, hits: str, ts: str, now: Column, high: int = 60) -> DataFrame:
    """One row: rows, mean score, rows over ``high``, under 20, with matches, of today and of the last seven days."""
    s = F.col(score)
    return df.agg(
        F.count("*").alias("reports"), F.avg(s).alias("avg_score"), count_if(s >= high).alias("high"), count_if(s < 20).alias("clean"),
        count_if(F.col(hits) > 0).alias("duplicates"), count_if(F.to_date(ts) == F.to_date(now)).alias("today"),
        count_if(F.col(ts) >= now - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"),
    )


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """Five rows (bucket, count), zeros included, from one pass of conditional counts."""
    counts = df.agg(*[count_if(F.col(score).between(lo, hi)).alias(f"b{lo}") for lo, hi in STATS_BANDS])
    pairs = F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("bucket"), F.col(f"b{lo}").alias("count")) for lo, hi in STATS_BANDS])
    return counts.select(F.inline(pairs))


def daily_trend(df: DataFrame, score: str, ts: str) -> DataFrame:
    """Per day: rows, mean score (one place) and rows in each tier."""
    s = F.col(score)
    names = ["Clean", *[n for _, n in reversed(TIER_CUTS)]]
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("reports"), (F.floor(F.avg(s) * 10 + 0.5) / 10).alias("avg_score"),
        *[count_if(tier(s) == n).alias(n.lower().replace(" ", "_")) for n in names],
    )


def feedback_trend(df: DataFrame, rating: str, helpful: str, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("feedback"), (F.floor(F.avg(rating) * 100 + 0.5) / 100).alias("avg_rating"),
        rate(count_if(F.col(helpful)) * 100, F.count("*"), 1).alias("agreement_pct"),
    )


def distinct_visitors(df: DataFrame, visitor: str, ts: str) -> DataFrame:
    """Exact counts of visitors, of days and of (visitor, day) pairs."""
    pairs = df.select(F.col(visitor).alias("v"), F.to_date(ts).alias("d")).distinct()
    return pairs.agg(F.countDistinct("v").alias("visitors"), F.countDistinct("d").alias("days"), F.count("*").alias("visits"))


def top_k(df: DataFrame, key: str | Column, k: int = 10, name: str = "key") -> DataFrame:
    """The ``k`` commonest values with their counts; ties by value. A report of k rows, so one sorted limit."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name).limit(k)


def feed_summary(df: DataFrame, score: str, family: str) -> DataFrame:
    """Total, tier counts and family counts in one pass of grouping sets: (tier, family, reports, avg_score)."""
    t = df.select(tier(F.col(score)).alias("tier"), F.coalesce(F.col(family), F.lit("FLAT")).alias("family"), F.col(score).alias("s"))
    t = t.groupingSets([[], [F.col("tier")], [F.col("family")]], F.col("tier"), F.col("family"))
    return t.agg(F.count("*").alias("reports"), (F.floor(F.avg("s") * 10 + 0.5) / 10).alias("avg_score"))


def distinct_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values of several columns of small domains, one pass, comma-joined."""
    return df.agg(*[F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in columns])


def semver_desc(df: DataFrame, version: str) -> DataFrame:
    """Distinct dotted versions, newest first, with their place."""
    d = df.where(F.col(version).isNotNull()).select(F.col(version).alias("version")).distinct().withColumn("p", F.transform(F.split("version", r"\."), lambda p: p.cast("int")))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p"), F.desc("version"))).cast("bigint")).select("place", "version")


def cohort_bins(df: DataFrame, score: str) -> DataFrame:
    """Ten rows (bin, low, high, count, cumulative), zeros included."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.floor(F.least(F.col(score), F.lit(99)) / 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    full = spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("count"))
    high = F.when(F.col("bin") == 9, 100).otherwise(F.col("bin") * 10 + 9).cast("int")
    return full.select("bin", (F.col("bin") * 10).alias("low"), high.alias("high"), "count", F.sum("count").over(Window.orderBy("bin")).cast("bigint").alias("cumulative"))


def median_of_bins(bins: DataFrame) -> DataFrame:
    """Middle of the first bin that reaches half of all rows; null without rows."""
    total = bins.agg(F.sum("count").alias("total"))
    at = bins.crossJoin(F.broadcast(total)).where((F.col("total") > 0) & (F.col("cumulative") * 2 >= F.col("total")))
    return at.agg(F.min_by(js_round((F.col("low") + F.col("high")) / 2), F.col("bin")).alias("median"))


def bin_percentile(df: DataFrame, bins: DataFrame, id_col: str, score: str) -> DataFrame:
    """Per row the mid-rank percentile of its bin; the ten bins are broadcast."""
    b = bins.select("bin", "count", (F.col("cumulative") - F.col("count")).alias("below"), F.sum("count").over(Window.partitionBy()).alias("total"))
    own = F.floor(F.least(F.col(score), F.lit(99)) / 10).cast("int")
    hit = df.select(id_col, score, own.alias("bin")).join(F.broadcast(b), "bin")
    return hit.select(id_col, score, js_round((F.col("below") + F.col("count") / 2) / F.col("total") * 100).alias("percentile"))


def mid_rank(df: DataFrame, id_col: str, score: str) -> DataFrame:
    """Per row the exact mid-rank percentile (one place): (below + equal / 2) / all.

    Ranks are taken over the distinct scores, so the ordered window sees one row
    per score; the table of scores is joined back by key.
    """
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    w = Window.orderBy(score)
    ranked = per.select(score, "n", (F.sum("n").over(w) - F.col("n")).alias("below"), F.sum("n").over(Window.partitionBy()).alias("total"))
    pct = F.floor((F.col("below") + F.col("n") / 2) / F.col("total") * 100 * 10 + 0.5) / 10
    return df.select(id_col, score).join(ranked, score).select(id_col, score, pct.alias("percentile"))


def medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rounded median per key (engine medians after unnesting). Values are scores, whole numbers from 0 to 100, so a key has at most 101 different ones; for others see :func:`latency`."""
    return df.groupBy(key).agg(js_round(F.percentile(value, F.lit(0.5))).alias("median"), F.count("*").alias("samples"))


#: Slots for each doubling of a value in the first round of :func:`latency`.
SLOTS = 64


def latency(df: DataFrame, value: str, by: Sequence[str | Column]) -> DataFrame:
    """Exact percentiles by linear interpolation (one place) per group, of values from 0.

    First the values are counted in logarithmic slots, a few thousand a group at
    most; then only those slots are looked into that hold one of the ranks asked for,
    each by itself. No task holds the values of a group.
    """
    v = F.col(value).cast("double")
    slot = F.when(F.isnan(v), 2**63 - 1).otherwise(F.floor(F.log2(v + 1) * SLOTS)).cast("bigint")
    d = df.where(v >= 0).select(*by, v.alias("__v"), slot.alias("__slot"))
    keys = d.columns[:-2]
    names = ("p50", "p95", "p99")
    at = dict(zip(names, ((F.col("samples") - 1) * q for q in (0.5, 0.95, 0.99))))
    ranks = {f"{n}{side}": cut(p).cast("bigint") for n, p in at.items() for side, cut in (("_low", F.floor), ("_high", F.ceil))}

    per = d.groupBy(*keys, "__slot").agg(F.count("*").alias("__n"))
    per = per.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slot")) - F.col("__n")).withColumn("samples", F.sum("__n").over(Window.partitionBy(*keys)))
    asked = F.lit(False)
    for r in ranks.values():
        asked = asked | ((F.col("__before") <= r) & (r < F.col("__before") + F.col("__n")))
    wanted = per.where(asked).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__slot").alias("__own"), "__before", "samples")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__slot") == F.col("__own")]
    each = d.join(wanted, same).groupBy(*keys, "__slot", "__v").agg(F.count("*").alias("__m"), F.first("__before").alias("__before"), F.first("samples").alias("samples"))
    each = each.withColumn("__from", F.col("__before") + F.sum("__m").over(Window.partitionBy(*keys, "__slot").orderBy("__v")) - F.col("__m"))
    inside = lambda r: (F.col("__from") <= r) & (r < F.col("__from") + F.col("__m"))
    got = each.groupBy(*keys).agg(F.coalesce(F.max("samples"), F.lit(0)).cast("bigint").alias("samples"), *[F.max(F.when(inside(r), F.col("__v"))).alias(n) for n, r in ranks.items()])
    between = lambda n: F.when(F.col(f"{n}_low") == F.col(f"{n}_high"), F.col(f"{n}_low")).otherwise(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (at[n] - F.floor(at[n])))
    return got.select(*keys, *[rnd(rnd(between(n), 6), 1).alias(n) for n in names], "samples")


def latency_bins(df: DataFrame, value: str, by: str) -> DataFrame:
    """Rows (key, lt_ms, count): ten half-open bins and the overflow (lt_ms null)."""
    v = F.col(value)
    edges = [(lo, hi) for lo, hi in zip((None, *BIN_EDGES), (*BIN_EDGES, None))]
    test = lambda lo, hi: (v < hi if lo is None else v >= lo if hi is None else (v >= lo) & (v < hi))
    counts = df.groupBy(by).agg(*[count_if(test(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(edges)])
    rows = F.array(*[F.struct(F.lit(hi).cast("int").alias("lt_ms"), F.col(f"b{i}").alias("count")) for i, (_, hi) in enumerate(edges)])
    return counts.select(by, F.inline(rows))


def worst_stage(df: DataFrame, stage: str, value: str, ratio: float = 1.5, share: float = 0.25) -> DataFrame:
    """The stage with the highest p95 if that is ``ratio`` times the (upper) median p95 and ``share`` of the whole's: none or one row."""
    per = latency(df, value, [stage]).select(F.col(stage).alias("stage"), "p95")
    whole = latency(df, value, []).select(F.col("p95").alias("all_p95"))
    ranked = per.agg(F.sort_array(F.collect_list(F.struct("p95", "stage"))).alias("s"))  # one row per stage, a small domain
    n = F.size("s")
    top = ranked.select(F.element_at("s", -1).alias("t"), F.col("s")[F.floor(n / 2).cast("int")]["p95"].alias("median"), n.alias("n"))
    both = top.crossJoin(F.broadcast(whole)).where((F.col("n") >= 2) & (F.col("median") > 0) & (F.col("t.p95") / F.col("median") >= ratio) & (F.col("t.p95") / F.col("all_p95") >= share))
    return both.select(F.col("t.stage").alias("stage"), F.col("t.p95").alias("p95"), F.col("all_p95").alias("pipeline_p95"), rnd(F.col("t.p95") / F.col("median"), 2).alias("ratio"))


def uptime(df: DataFrame, engine: str, ts: str, now: Column, days: int = 30) -> DataFrame:
    """Per engine: active days in the window, uptime in per cent, last sighting and its status (1 h, 6 h)."""
    recent = df.where((F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= now))
    age = (seconds(now) - seconds(F.max(F.col(ts)))) / 3600
    return recent.groupBy(F.col(engine).alias("engine")).agg(
        F.countDistinct(F.to_date(ts)).alias("active_days"), (F.floor(F.countDistinct(F.to_date(ts)) / days * 1000 + 0.5) / 10).alias("uptime_pct"), F.max(ts).alias("last_seen"),
        F.when(age <= 1, "operational").when(age <= 6, "degraded").otherwise("down").alias("status"),
    )


def gaps(df: DataFrame, engine: str, ts: str, now: Column, hours: float = 1.0) -> DataFrame:
    """Silences over ``hours`` per engine: (engine, started, ended), the last one open.

    The previous event is found over one row per engine and minute, so a busy
    engine's window holds minutes, not events: within a minute only the first and
    last event can border a gap.
    """
    m = df.groupBy(F.col(engine).alias("engine"), F.date_trunc("minute", ts).alias("m")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    w = Window.partitionBy("engine").orderBy("m")
    nxt = m.withColumn("next", F.lead("first").over(w))
    long = lambda a, b: seconds(b) - seconds(a) > hours * 3600
    return nxt.where(long(F.col("last"), F.coalesce("next", now))).select("engine", F.col("last").alias("started"), F.col("next").alias("ended"))


def incidents(gap_rows: DataFrame, now: Column, engines: int) -> DataFrame:
    """Overlapping gaps of all engines merged: (started, ended, engines, severity); ended is null while open.

    Gaps are rare by definition; the ordered window over all of them is the merge itself.
    """
    g = gap_rows.withColumn("end", F.coalesce("ended", now))
    w = Window.orderBy("started", "end", "engine")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = g.withColumn("before", before).withColumn("new", F.when(F.col("before").isNull() | (F.col("started") > F.col("before")), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(w))
    out = marked.groupBy("island").agg(
        F.min("started").alias("started"), F.when(count_if(F.col("ended").isNull()) == 0, F.max("ended")).alias("ended"), F.sort_array(F.collect_set("engine")).alias("e")
    )
    return out.select("started", "ended", F.array_join("e", ",").alias("engines"), F.when(F.size("e") >= engines, "outage").otherwise("degraded").alias("severity"))
