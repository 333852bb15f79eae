"""Structured Streaming forms: velocity, campaigns, caps, tumbling latency, alert deduplication, brute force.

Event time with a watermark of one hour; later rows are dropped. State is keyed
(by visitor, or visitor and day), so it spreads over the cluster, and it is
cleared by event-time timeouts, so it does not grow with history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import limits

WATERMARK = "1 hour"


def _window_s(ts: list[int]) -> tuple[int, float | None, int]:
    n = len(ts)
    gap = (ts[-1] - ts[0]) / 1e6 / (n - 1) if n >= 2 else None
    penalty = (limits.BURST_PENALTY if n > limits.BURST else 0) + (limits.GAP_PENALTY if n >= limits.GAP_ROWS and gap is not None and gap < limits.GAP_S else 0)
    return n, gap, max(penalty, limits.FLOOR)


def velocity(events: DataFrame, visitor: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Per event (id, submissions, avg_gap_s, penalty), as :func:`sievemark.operators.limits.velocity` gives in batch.

    State of a (visitor, UTC day) is the times of its last 60 minutes.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        out = []
        for us, same in rows.groupby("us", sort=True):
            times = [t for t in times if t >= us - limits.WINDOW_S * 1_000_000] + [int(us)] * len(same)
            n, gap, penalty = _window_s(times)
            out += [(int(i), n, gap, penalty) for i in same["id"]]
        state.update((times,))
        state.setTimeoutTimestamp(max(int(rows["us"].max() // 1000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "submissions", "avg_gap_s", "penalty"])

    keyed = events.withWatermark(ts, WATERMARK).select(F.col(visitor).cast("string").alias("visitor"), F.to_date(ts).cast("string").alias("day"), F.unix_micros(F.col(ts)).alias("us"), F.col(id_col).alias("id"), F.col(ts).alias("ts"))
    return keyed.groupBy("visitor", "day").applyInPandasWithState(
        step, "event_id long, submissions long, avg_gap_s double, penalty long", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def daily_campaigns(events: DataFrame, fingerprint: str, ts: str = "ts") -> DataFrame:
    """Fingerprints seen at least three times in a UTC day: a tumbling window count."""
    w = events.withWatermark(ts, WATERMARK).groupBy(F.window(ts, "1 day").alias("w"), F.col(fingerprint).alias("fingerprint")).agg(F.count("*").alias("seen"))
    return w.where(F.col("seen") >= limits.CAMPAIGN).select(F.col("w.start").alias("day"), "fingerprint", "seen", F.lit(limits.CAMPAIGN_PENALTY).alias("penalty"))


def submission_cap(events: DataFrame, visitor: str = "user_id", ts: str = "ts", id_col: str = "event_id", cap: int = limits.DAILY_CAP) -> DataFrame:
    """Per event whether it is within the visitor's cap of the UTC day. State is one number."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        nth = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        state.setTimeoutTimestamp(max(int(rows["us"].max() // 1000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["id"].to_numpy(), "nth": list(nth), "accepted": [k <= cap for k in nth]})

    keyed = events.withWatermark(ts, WATERMARK).select(F.col(visitor).cast("string").alias("visitor"), F.to_date(ts).cast("string").alias("day"), F.unix_micros(F.col(ts)).alias("us"), F.col(id_col).alias("id"), F.col(ts).alias("ts"))
    return keyed.groupBy("visitor", "day").applyInPandasWithState(step, "event_id long, nth long, accepted boolean", "n long", "append", GroupStateTimeout.EventTimeTimeout)


def daily_latency(events: DataFrame, stage: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """Count, mean and approximate p95 per day and stage."""
    w = events.withWatermark(ts, WATERMARK).groupBy(F.window(ts, "1 day").alias("w"), F.col(stage).alias("stage"))
    return w.agg(F.count("*").alias("samples"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.95, 10_000).alias("p95")).select(F.col("w.start").alias("day"), "stage", "samples", "mean", "p95")


def activity_sessions(events: DataFrame, engine: str = "event_type", ts: str = "ts", gap: str = "1 hour") -> DataFrame:
    """Stretches of activity without a gap; what lies between two is an incident."""
    s = events.withWatermark(ts, WATERMARK).groupBy(F.session_window(ts, gap).alias("w"), F.col(engine).alias("engine")).agg(F.count("*").alias("events"))
    return s.select("engine", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def brute_force(events: DataFrame, address: str, ts: str = "ts", least: int = limits.REJECTIONS, seconds: int = limits.REJECT_WINDOW_S) -> DataFrame:
    """Sliding windows in which an address is rejected at least ``least`` times."""
    w = events.withWatermark(ts, WATERMARK).groupBy(F.window(ts, f"{seconds} seconds", f"{max(1, seconds // 6)} seconds").alias("w"), F.col(address).alias("address")).agg(F.count("*").alias("rejections"))
    return w.where(F.col("rejections") >= least).select("address", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "rejections")


def once(alerts: DataFrame, key: str, ts: str = "ts", within: str = "1 day") -> DataFrame:
    """Each alert key once within a time."""
    return alerts.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
