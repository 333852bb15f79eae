"""Rates of submission per visitor in batch: velocity, campaigns, caps, rejections.

Windows are partitioned by visitor and day, so no window outgrows a day of one
visitor; the time range inside it is what the rule names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import micros

#: Fixed values of the rules.
WINDOW_S, BURST, BURST_PENALTY, GAP_S, GAP_ROWS, GAP_PENALTY, FLOOR = 3600, 10, -15, 30.0, 3, -10, -15
CAMPAIGN, CAMPAIGN_PENALTY = 3, -20
DAILY_CAP, RUN_CAP, RUN_WINDOW_S = 20, 10, 86_400
REJECTIONS, REJECT_WINDOW_S = 10, 60


def _micros(ts: str):
    return F.unix_micros(F.col(ts))


def velocity(df: DataFrame, visitor: str, ts: str) -> DataFrame:
    """Add per event: ``submissions`` in the last 60 minutes of the same UTC day, ``avg_gap_s`` and ``penalty``. No visitor, no penalty."""
    has = F.col(visitor).isNotNull()
    apart = F.when(~has, micros(ts))  # rows without a visitor count nothing, so they need not meet in one task
    w = Window.partitionBy(visitor, F.to_date(ts), apart).orderBy(micros(ts)).rangeBetween(-WINDOW_S * 1_000_000, 0)
    d = df.withColumn("submissions", F.when(has, F.count("*").over(w)).otherwise(0).cast("bigint"))
    span = (micros(ts) - F.min(micros(ts)).over(w)) / 1e6
    d = d.withColumn("avg_gap_s", F.when(has & (F.col("submissions") >= 2), span / (F.col("submissions") - 1)))
    burst = F.when(F.col("submissions") > BURST, BURST_PENALTY).otherwise(0)
    tight = F.when((F.col("submissions") >= GAP_ROWS) & (F.col("avg_gap_s") < GAP_S), GAP_PENALTY).otherwise(0)
    return d.withColumn("penalty", F.greatest(burst + tight, F.lit(FLOOR)).cast("bigint"))


def nth_of_day(df: DataFrame, key: str, ts: str, id_col: str, name: str) -> DataFrame:
    """Add the place of each row among those of its key and UTC day, by time and id.

    Rows are numbered within their minute, after the counts of the day's minutes
    before it, so a key with many rows is spread over its minutes. Null keys and
    times are keys as others.
    """
    parts = {"__key": F.col(key), "__day": F.to_date(ts), "__minute": F.floor(micros(ts) / 60_000_000).cast("bigint")}
    d = df.withColumns(parts)
    per = d.groupBy(*parts).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__key", "__day").orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*[F.col(c).alias(f"{c}_") for c in parts], F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in parts]
    own = F.row_number().over(Window.partitionBy(*parts).orderBy(ts, id_col))
    return d.join(before, same).withColumn(name, (F.col("__before") + own).cast("bigint")).select(*df.columns, name)


def campaign(df: DataFrame, fingerprint: str, ts: str, id_col: str) -> DataFrame:
    """Add ``seen`` (running count of the fingerprint in the UTC day) and ``campaign_penalty``."""
    d = nth_of_day(df, fingerprint, ts, id_col, "seen")
    return d.withColumn("campaign_penalty", F.when(F.col("seen") >= CAMPAIGN, CAMPAIGN_PENALTY).otherwise(0).cast("bigint"))


def daily_cap(df: DataFrame, visitor: str, ts: str, id_col: str, cap: int = DAILY_CAP) -> DataFrame:
    """Add ``nth`` of the visitor's UTC day and whether it is ``accepted``."""
    return nth_of_day(df, visitor, ts, id_col, "nth").withColumn("accepted", F.col("nth") <= cap)


def fixed_bucket(df: DataFrame, visitor: str, ts: str, id_col: str, cap: int = RUN_CAP, seconds: int = RUN_WINDOW_S) -> DataFrame:
    """Add ``nth`` in a bucket of fixed length that starts with its first event, and ``accepted``.

    Where a bucket starts depends on the one before, so each visitor's events go
    in order through one task, which streams them: it holds a batch and three
    values, however many events a visitor has.
    """
    rows = df.select(F.col(visitor).cast("string").alias("who"), micros(ts).alias("t"), F.col(id_col).cast("bigint").alias("id"))
    rows = rows.repartition("who").sortWithinPartitions("who", "t", "id")
    length = seconds * 1_000_000

    def run(batches):
        who, start, n = None, None, 0
        for b in batches:
            nth = []
            for v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v != who:
                    who, start = v, None
                if start is None or t - start >= length:
                    start, n = t, 0
                n += 1
                nth.append(n)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(nth, pa.int64())], ["id", "nth"])

    nth = rows.mapInArrow(run, "id long, nth long")
    return nth.select(F.col("id").alias(id_col), "nth", (F.col("nth") <= cap).alias("accepted"))


def rejection_bursts(df: DataFrame, address: str, ts: str, least: int = REJECTIONS, seconds: int = REJECT_WINDOW_S) -> DataFrame:
    """Events at which an address reaches ``least`` rejections within ``seconds``; within a cooldown of that length only the first one alerts.

    Runs of alert-worthy events no further apart than the cooldown are an island and
    an island alerts once each full cooldown from its start.
    """
    w = Window.partitionBy(address).orderBy(micros(ts))
    hot = df.withColumn("in_window", F.count("*").over(w.rangeBetween(-seconds * 1_000_000, 0))).where(F.col("in_window") >= least)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    isl = hot.withColumn("new", F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    first = F.min(micros(ts)).over(Window.partitionBy(address, "island"))
    slot = isl.withColumn("slot", F.floor((micros(ts) - first) / (seconds * 1_000_000)))
    return slot.groupBy(address, "island", "slot").agg(F.min(ts).alias("alert_at"), F.max("in_window").alias("rejections")).select(address, "alert_at", "rejections")
