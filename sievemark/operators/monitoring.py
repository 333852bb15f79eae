"""Watching scores over time: weekly drift, flips between scorings, shadow scores, compaction and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rnd, seconds
from .analytics import count_if, rate, tier

#: Fixed values of the drift report.
MIN_BUCKET, GAP_WARN, SHIFT_WARN = 3, 45.0, 5.0
LEGIT, SLOP = ("Clean", "Likely Human"), ("Likely Slop", "Slop")


def _one(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def bucket_of_label(label: Column) -> Column:
    return F.when(label.isin("STRONG", "PROMISING"), "T1").when(label.isin("LIKELY INVALID", "HIGH RISK"), "T3").otherwise("NEUTRAL")


def weekly_gap(df: DataFrame, ts: str, label: str, composite: str) -> DataFrame:
    """Per UTC-Monday week: rows, counts and means (one place) of both ends, their gap and whether it counts."""
    b = df.select(F.to_date(F.date_trunc("WEEK", ts)).alias("week"), bucket_of_label(F.col(label)).alias("b"), F.col(composite).alias("c"))
    n = lambda k: count_if(F.col("b") == k)
    mean = lambda k: _one(F.avg(F.when(F.col("b") == k, F.col("c"))))
    w = b.groupBy("week").agg(F.count("*").alias("reports"), n("T1").alias("t1_count"), mean("T1").alias("t1_mean"), n("T3").alias("t3_count"), mean("T3").alias("t3_mean"))
    return w.withColumn("gap", rnd(F.col("t1_mean") - F.col("t3_mean"), 1)).withColumn("eligible", (F.col("t1_count") >= MIN_BUCKET) & (F.col("t3_count") >= MIN_BUCKET))


def family_shifts(df: DataFrame, ts: str, label: str, composite: str, family: str) -> DataFrame:
    """Means per (bucket, family) that moved by ``SHIFT_WARN`` against the previous week that has any rows."""
    b = df.select(F.to_date(F.date_trunc("WEEK", ts)).alias("week"), bucket_of_label(F.col(label)).alias("bucket"), F.col(family).alias("family"), F.col(composite).alias("c"))
    # Weeks are few whatever the rows: number them to find the previous existing one.
    weeks = b.select("week").distinct().withColumn("k", F.row_number().over(Window.orderBy("week")))
    m = b.where("bucket <> 'NEUTRAL'").groupBy("week", "bucket", "family").agg(F.count("*").alias("n"), _one(F.avg("c")).alias("mean")).where(F.col("n") >= MIN_BUCKET).join(F.broadcast(weeks), "week")
    old = m.select((F.col("k") + 1).alias("k"), "bucket", "family", F.col("mean").alias("old_mean"), F.col("week").alias("old_week"))
    j = m.join(old, ["k", "bucket", "family"]).withColumn("shift", rnd(F.col("mean") - F.col("old_mean"), 1))
    return j.where(F.abs("shift") >= SHIFT_WARN).select("week", "bucket", "family", "old_week", "old_mean", "mean", "shift")


def drift_flags(weeks: DataFrame, shifts: DataFrame) -> DataFrame:
    """Rows (flag_key, week, kind) of weeks under the gap limit and of shifted families."""
    low = weeks.where(F.col("eligible") & (F.col("gap") < GAP_WARN)).select(F.concat_ws("|", F.lit("GAP_BELOW_45"), F.col("week").cast("string")).alias("flag_key"), "week", F.lit("GAP_BELOW_45").alias("kind"))
    moved = shifts.select(F.concat_ws("|", F.lit("FAMILY_MEAN_SHIFT"), F.col("week").cast("string"), "bucket", "family").alias("flag_key"), "week", F.lit("FAMILY_MEAN_SHIFT").alias("kind"))
    return low.unionByName(moved)


def new_flags(flags: DataFrame, notified: DataFrame) -> DataFrame:
    """Flags not in ``notified`` (flag_key), each once."""
    return flags.dropDuplicates(["flag_key"]).join(notified.select("flag_key"), "flag_key", "left_anti")


def public_drift(weeks: DataFrame, last: int = 12) -> DataFrame:
    """The last eligible weeks (a fixed number of them) with the change to the one before."""
    e = weeks.where(F.col("eligible") & F.col("gap").isNotNull())
    e = e.withColumn("back", F.row_number().over(Window.orderBy(F.desc("week")))).where(F.col("back") <= last)
    return e.select("week", F.col("gap").alias("spread"), rnd(F.col("gap") - F.lag("gap").over(Window.orderBy("week")), 1).alias("delta"))


def _side(t: Column) -> Column:
    return F.when(t.isin(*LEGIT), "legit").when(t.isin(*SLOP), "slop").otherwise("middle")


def flip_direction(old: Column, new: Column) -> Column:
    pair = F.concat_ws(">", _side(old), _side(new))
    return (
        F.when(old == new, "none").when(pair == "legit>slop", "legit_to_slop").when(pair == "slop>legit", "slop_to_legit")
        .when(pair.isin("legit>middle", "middle>slop"), "tightened").when(pair.isin("slop>middle", "middle>legit"), "loosened").otherwise("lateral")
    )


def rescore(df: DataFrame, id_col: str, old: Column, new: Column, ts: str) -> DataFrame:
    """Log of a second scoring: (report_id, old_score, new_score, old_tier, new_tier, direction, scored_at)."""
    s = df.select(F.col(id_col).alias("report_id"), old.alias("old_score"), new.alias("new_score"), F.col(ts).alias("scored_at"))
    s = s.withColumn("old_tier", tier(F.col("old_score"))).withColumn("new_tier", tier(F.col("new_score")))
    return s.withColumn("direction", flip_direction(F.col("old_tier"), F.col("new_tier")))


def flip_summary(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Per day of the window (zeros included) and in total (day null): rows, flips by direction, rate (four places)."""
    kinds = ("legit_to_slop", "slop_to_legit", "tightened", "loosened", "lateral")
    recent = log.where((F.col("scored_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("scored_at") <= now))
    per = recent.groupBy(F.to_date("scored_at").alias("day")).agg(F.count("*").alias("total"), *[count_if(F.col("direction") == k).alias(k) for k in kinds])
    spine = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(now), days - 1), F.to_date(now))).alias("day"))
    full = spine.join(per, "day", "full_outer").fillna(0, ["total", *kinds])
    rolled = full.rollup("day").agg(*[F.sum(c).alias(c) for c in ("total", *kinds)])
    flips = sum((F.col(k) for k in kinds), F.lit(0).cast("bigint"))
    return rolled.select("day", "total", flips.alias("flips"), *kinds, rate(flips, F.col("total"), 4).alias("flip_rate"))


def flips_of_day(log: DataFrame, day: Column) -> DataFrame:
    return log.where((F.to_date("scored_at") == day) & (F.col("direction") != "none")).select("report_id", "old_tier", "new_tier", "old_score", "new_score", "direction")


def replay_gate(log: DataFrame, last: int = 100, limit: float = 0.005) -> DataFrame:
    """Tier flips among the ``last`` rows scored (a fixed sample by definition) and whether the gate holds."""
    recent = log.orderBy(F.desc("scored_at"), F.desc("report_id")).limit(last)
    flips = count_if(F.col("direction") != "none")
    return recent.agg(F.count("*").alias("total_reports"), flips.alias("flip_count"), rate(flips, F.count("*"), 4).alias("flip_rate"), (flips <= F.count("*") * limit).alias("passed"))


def shadow_drift(live: DataFrame, shadow: DataFrame, least: int = 10, rate_limit: float = 0.1, flip_limit: int = 20) -> DataFrame:
    """Shadow scores (report_id, shadow_score) against live ones (report_id, score): divergence, flips across the middle, alert."""
    j = shadow.join(live, "report_id", "left")
    lt, st = tier(F.col("score")), tier(F.col("shadow_score"))
    diverged = (lt != st) | (F.abs(F.col("score") - F.col("shadow_score")) >= least)
    crossed = flip_direction(lt, st).isin("legit_to_slop", "slop_to_legit")
    one = j.agg(F.count("*").alias("total"), count_if(diverged).alias("diverged"), count_if(crossed).alias("crossed"))
    r = rate(F.col("diverged"), F.col("total"), 4)
    return one.select("total", "diverged", r.alias("divergence_rate"), F.col("crossed").alias("legit_slop_flips"), ((r > rate_limit) | (F.col("crossed") > flip_limit)).alias("alert"))


def compact_snapshots(df: DataFrame, now: Column, days: int) -> DataFrame:
    """Snapshots (ts, archetype, count, mean, max, ceiling) older than ``days`` as one row per day and archetype; others as they are."""
    cutoff = now - F.expr(f"INTERVAL {days} DAYS")
    w = F.greatest(F.col("count"), F.lit(1))
    old = df.where(F.col("ts") < cutoff).groupBy(F.date_trunc("DAY", "ts").alias("ts"), "archetype").agg(
        F.sum("count").cast("bigint").alias("count"), rnd(F.sum(F.col("mean") * w) / F.sum(w), 2).alias("mean"), rnd(F.max("max"), 2).alias("max"), F.min_by("ceiling", F.col("ts")).alias("ceiling"),
        F.lit(True).alias("aggregated"),
    )
    recent = df.where(F.coalesce(F.col("ts") >= cutoff, F.lit(True))).select("ts", "archetype", F.col("count").cast("bigint").alias("count"), "mean", "max", "ceiling", F.lit(False).alias("aggregated"))
    return old.unionByName(recent).withColumn("min_distance", rnd(F.col("ceiling") - F.col("max"), 2))


def compact_means(df: DataFrame, key: str, ts: str, value: str, weight: str, sample: str) -> DataFrame:
    """Per day and key the weighted mean of what is not null, and the last sample that is not empty."""
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(F.to_date(ts).alias("day"), F.col(key)).agg(
        F.sum(weight).cast("bigint").alias("weight"), rnd(F.sum(v * w) / F.sum(w), 2).alias("mean"), F.max_by(F.col(sample), F.when((F.col(sample).isNotNull()) & (F.col(sample) != ""), F.struct(F.col(ts), F.col(sample)))).alias("sample")
    )


def cohort_battery(df: DataFrame, family: str, level: str, score: str) -> DataFrame:
    """Per family the mean score of both ends and their gap."""
    m = lambda k: _one(F.avg(F.when(F.col(level) == k, F.col(score))))
    g = df.groupBy(F.col(family).alias("family")).agg(count_if(F.col(level) == "T1").alias("t1_count"), m("T1").alias("t1_mean"), count_if(F.col(level) == "T3").alias("t3_count"), m("T3").alias("t3_mean"))
    return g.withColumn("gap", rnd(F.col("t1_mean") - F.col("t3_mean"), 1))


def daily_sample(df: DataFrame, label: str, id_col: str, day: str, n: int) -> DataFrame:
    """``n`` rows per label for a day (a sampling operator), the smallest by MD5 of day and id."""
    h = F.md5(F.concat(F.lit(day), F.lit("|"), F.col(id_col).cast("string")).cast("binary"))
    rn = F.row_number().over(Window.partitionBy(label).orderBy("__h", id_col))
    return df.withColumn("__h", h).withColumn("rank", rn).where(F.col("rank") <= n).drop("__h").withColumn("rank", F.col("rank").cast("bigint"))


def summary_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"), rnd(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def queue_stats(df: DataFrame, status: str, ts: str, now: Column) -> DataFrame:
    """Rows by status and this week's arrivals against last week's (per cent null where there were none)."""
    age = (seconds(now) - seconds(ts)) / 86400
    n = lambda s: count_if(F.col(status) == s)
    one = df.agg(n("pending").alias("pending"), n("promoted").alias("promoted"), n("rejected").alias("rejected"), count_if((age >= 0) & (age < 7)).alias("this_week"), count_if((age >= 7) & (age < 14)).alias("last_week"))
    d = F.col("this_week") - F.col("last_week")
    return one.withColumn("delta", d).withColumn("delta_pct", rnd(d * 100.0 / F.nullif("last_week", F.lit(0)), 1))


def retention(df: DataFrame, ts: str, status: str, score: str, now: Column, abandon_days: int = 30, delete_days: int = 90) -> DataFrame:
    """What a prune does with each row: keep, mark abandoned, or delete (abandoned for long, or dust: never scored)."""
    age = (seconds(now) - seconds(ts)) / 86400
    act = F.when((F.col(status) == "abandoned") & (age > delete_days), "delete").when(F.col(score).isNull() & (age > abandon_days), "delete_dust").when((F.col(status) == "pending") & (age > abandon_days), "mark_abandoned").otherwise("keep")
    return df.withColumn("action", act)


def prune(df: DataFrame) -> DataFrame:
    """The rows that stay after :func:`retention`, to be written over the partition."""
    return df.where(~F.col("action").isin("delete", "delete_dust"))


def nearest_within(left: DataFrame, right: DataFrame, key: str, ts: str, within: int = 60) -> DataFrame:
    """For each left row (id, key, ts) the right row (rid, key, ts) of the same key nearest in time, within ``within`` seconds; ties to the smaller rid.

    An equi-join on key and time slot: each right row goes to its own slot and the
    two beside it, so a key with many rows is spread over its slots.
    """
    slot = F.floor(seconds(ts) / within).cast("bigint")
    a = left.select("id", key, F.col(ts).alias("lts"), slot.alias("slot"))
    b = right.select("rid", key, F.col(ts).alias("rts"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    gap = F.abs(seconds("lts") - seconds("rts"))
    near = a.join(b, [key, "slot"]).withColumn("gap", gap).where(F.col("gap") <= within)
    return near.groupBy("id").agg(F.min(F.struct("gap", "rid")).alias("m")).select("id", F.col("m.rid").alias("rid"), rnd(F.col("m.gap"), 3).alias("gap_s"))


def phrase_dry_run(df: DataFrame, text: Column, level: Column, phrase: str) -> DataFrame:
    """Rows that a phrase would hit, by tier, and how many of them are legitimate."""
    hit = df.where(text.contains(phrase)).select(level.alias("tier"))
    return hit.groupBy("tier").agg(F.count("*").alias("matches")).withColumn("false_positive", F.col("tier").isin(*LEGIT))


def phrase_removal(df: DataFrame, text: Column, removed: list[str], remaining: list[str]) -> DataFrame:
    """Rows that a removed phrase hits and no remaining one."""
    any_of = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: text.contains(p)) if ps else F.lit(False)
    return df.where(any_of(removed) & ~any_of(remaining))


def first_match_stats(df: DataFrame, id_col: str, values: str, score: str) -> DataFrame:
    """Per value: rows whose first array element it is, and their mean score."""
    first = df.where(F.size(values) > 0).select(id_col, F.element_at(values, 1).alias("value"), score)
    return first.groupBy("value").agg(F.count("*").alias("reports"), _one(F.avg(score)).alias("avg_score"))


def scheduler_health(df: DataFrame, now: Column, grace: float) -> DataFrame:
    """``stalled`` and ``overdue`` of schedulers (started, next_tick, interval_s, retry_s; seconds).

    Stalled: two intervals past the next tick. Overdue: past it by the retry interval
    (none: 0) and ``grace``. One that has not started, or has no next tick, is neither.
    """
    late = seconds(now) - seconds("next_tick")
    on = lambda test: F.coalesce(F.col("started") & test, F.lit(False))
    return df.withColumn("stalled", on(late > 2 * F.col("interval_s"))).withColumn("overdue", on(late > F.coalesce("retry_s", F.lit(0)) + grace))


#: Note of a trace that no report caused. Fixed value.
HEARTBEAT = "synthetic_heartbeat"


def heartbeats(replicas: DataFrame, first: Column, last: Column, every: str = "5 minutes") -> DataFrame:
    """Synthetic traces of each replica at regular times: (replica, created_at, report_id null, notes)."""
    at = F.explode(F.sequence(first, last, F.expr(f"INTERVAL {every}")))
    return replicas.select("replica", at.alias("created_at"), F.lit(None).cast("bigint").alias("report_id"), F.array(F.lit(HEARTBEAT)).alias("notes"))


def prune_heartbeats(traces: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Traces without synthetic ones older than ``days``: a trace goes only if it is old, has no report and bears the note."""
    old = F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")
    return traces.where(~F.coalesce(old & F.col("report_id").isNull() & F.array_contains("notes", HEARTBEAT), F.lit(False)))
