"""Incidents, velocity, caps and their streaming forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievemark.operators import analytics as an
from sievemark.operators import limits
from sievemark.operators import monitoring as mo

T0 = datetime(2024, 1, 1, 12)


def at(minutes=0, seconds=0, us=0):
    return T0 + timedelta(minutes=minutes, seconds=seconds, microseconds=us)


def test_gaps_and_merge(spark):
    rows = [("a", at(0)), ("a", at(60)), ("a", at(180)), ("b", at(0)), ("b", at(60, 0, 1)), ("b", at(200)), ("b", at(201))]
    d = spark.createDataFrame(rows, "engine string, ts timestamp")
    now = F.lit(at(230)).cast("timestamp")
    g = {(r.engine, r.started, r.ended) for r in an.gaps(d, "engine", "ts", now).collect()}
    assert g == {("a", at(60), at(180)), ("b", at(0), at(60, 0, 1)), ("b", at(60, 0, 1), at(200))}
    got = [(r.started, r.ended, r.engines, r.severity) for r in an.incidents(an.gaps(d, "engine", "ts", now), now, 2).collect()]
    assert got == [(at(0), at(200), "a,b", "outage")]
    late = F.lit(at(400)).cast("timestamp")
    assert {r.ended for r in an.incidents(an.gaps(d, "engine", "ts", late), late, 2).collect()} == {None}


def test_incident_queries_see_all_events(spark, duck, tmp_path):
    from sievemark.plans.all import QUERIES, SQL

    # Silent for 3 hours if only users divisible by 20 count; user 7 is seen in between.
    rows = [(20, "a", at(0)), (7, "a", at(50)), (7, "a", at(100)), (20, "a", at(150)), (20, "b", at(0)), (40, "b", at(90))]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    last = {("a", at(150), None), ("b", at(90), None)}
    assert {tuple(r) for r in QUERIES["gap_incidents_all"](spark, str(tmp_path)).collect()} == {("b", at(0), at(90)), *last}
    got = {(r.started, r.ended, r.engines) for r in QUERIES["merged_incidents_all"](spark, str(tmp_path)).collect()}
    assert got == {(at(0), None, "a,b")}
    assert "%" not in SQL["gap_incidents_all"]


def test_no_events_no_gaps(spark):
    d = spark.createDataFrame([], "engine string, ts timestamp")
    now = F.lit(T0).cast("timestamp")
    assert an.incidents(an.gaps(d, "engine", "ts", now), now, 2).count() == 0


EVENTS = [("u", at(k)) for k in range(11)] + [("v", at(0, 0)), ("v", at(0, 29)), ("v", at(0, 59, 900000)), ("w", at(0, 0)), ("w", at(0, 30)), ("w", at(0, 60))]
EVENTS += [("x", datetime(2024, 1, 1, 23, 59)), ("x", datetime(2024, 1, 2, 0, 0, 1)), (None, at(0))]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(EVENTS)], "event_id long, user_id string, ts timestamp")


def test_velocity(events):
    got = {r.event_id: (r.submissions, r.penalty) for r in limits.velocity(events, "user_id", "ts").collect()}
    assert got[9] == (10, 0) and got[10] == (11, -15)
    assert got[13] == (3, -10) and got[16] == (3, 0)  # mean gap 29.95 s and 30 s
    assert got[17] == (1, 0) and got[18] == (1, 0)  # midnight between
    assert got[19] == (0, 0)


def test_streaming_equals_batch(spark, events, tmp_path):
    from sievemark.streaming import checks

    rows = events.where("user_id IS NOT NULL")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, made, batch in (
        ("v", checks.velocity(stream), limits.velocity(rows, "user_id", "ts").select("event_id", "submissions", "avg_gap_s", "penalty")),
        ("c", checks.submission_cap(stream, cap=5), limits.daily_cap(rows, "user_id", "ts", "event_id", 5).select("event_id", "nth", "accepted")),
    ):
        q = made.writeStream.format("memory").queryName(f"stream_{name}").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"stream_{name}").collect())) == sorted(map(tuple, batch.collect()))


def test_campaign_and_cap(spark):
    d = spark.createDataFrame([(i, "f", at(i)) for i in range(4)], "id long, fp string, ts timestamp")
    assert [r.campaign_penalty for r in limits.campaign(d, "fp", "ts", "id").orderBy("id").collect()] == [0, 0, -20, -20]
    assert [r.accepted for r in limits.daily_cap(d, "fp", "ts", "id", 2).orderBy("id").collect()] == [True, True, False, False]


def test_buckets_of_a_visitor_with_most_events(spark):
    rows = [(i, "hot" if i % 3 else None if i % 5 else f"v{i % 7}", at(0, (i * 7919) % 500_000)) for i in range(30_000)]
    d = spark.createDataFrame(rows, "id long, v string, ts timestamp").repartition(7)
    got = limits.fixed_bucket(d, "v", "ts", "id", 10, 3600)
    assert "collect_list" not in got._jdf.queryExecution().toString()  # no row holds all events of a visitor
    want, state = {}, {}
    for i, v, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start, n = state.get(v, (None, 0))
        start, n = (t, 1) if start is None or (t - start).total_seconds() >= 3600 else (start, n + 1)
        state[v], want[i] = (start, n), (n, n <= 10)
    assert {r.id: (r.nth, r.accepted) for r in got.collect()} == want


def test_bands(spark):
    d = spark.createDataFrame([(x,) for x in (0, 19, 20, 21, 35, 36, 39, 40, 55, 56, 60, 75, 76, 80, 81, 100)], "s long")
    got = {r.s: (r.t, r.b, r.f) for r in d.select("s", an.tier(F.col("s")).alias("t"), an.stats_band(F.col("s")).alias("b"), an.feedback_band(F.col("s")).alias("f")).collect()}
    assert got[19][0] == "Clean" and got[20] == ("Likely Human", "0-20", "0-20") and got[21][1:] == ("21-35", "21-40")
    assert got[35][1] == "21-35" and got[36][1] == "36-55" and got[40][0] == "Questionable" and got[60][2] == "41-60" and got[80] == ("Slop", "76-100", "61-80") and got[81][2] == "81-100"


def test_flip_directions(spark):
    d = spark.createDataFrame([("Clean", "Slop"), ("Slop", "Clean"), ("Clean", "Questionable"), ("Slop", "Questionable"), ("Clean", "Likely Human"), ("Slop", "Slop")], "o string, n string")
    assert [r[0] for r in d.select(mo.flip_direction(F.col("o"), F.col("n"))).collect()] == ["legit_to_slop", "slop_to_legit", "tightened", "loosened", "lateral", "none"]


def test_week_starts_on_monday_utc(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 7, 23, 59), "STRONG", 90), (datetime(2024, 1, 8, 0, 0), "STRONG", 80)], "ts timestamp, l string, c int")
    assert sorted(str(r.week) for r in mo.weekly_gap(d, "ts", "l", "c").collect()) == ["2024-01-01", "2024-01-08"]


def test_median_and_percentile_from_empty(spark):
    d = spark.createDataFrame([], "id long, score long")
    bins = an.cohort_bins(d, "score")
    assert bins.count() == 10 and an.median_of_bins(bins).first()[0] is None


def test_percentiles_against_the_built_in(spark):
    import random

    from pyspark.sql import functions as F

    from sievemark.functions.text import rnd
    from sievemark.operators import analytics as an

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([0.0, 7.5, r.random() * 10 ** r.randint(0, 6)])) for _ in range(2000)] + [("one", 3.25), ("two", 1.0), ("two", 2.0), ("none", -1.0), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    for by in (["k"], [F.upper("k").alias("u")], []):
        want = d.where("v >= 0").groupBy(*by).agg(*[rnd(rnd(F.percentile("v", F.lit(q)), 6), 1).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.count("*").alias("samples"))
        assert sorted(map(str, an.latency(d, "v", by).collect())) == sorted(map(str, want.collect()))
    assert an.latency(d.where("false"), "v", ["k"]).count() == 0
    assert [tuple(x) for x in an.latency(d.where("false"), "v", []).collect()] == [(None, None, None, 0)]


def test_places_within_a_day(spark):
    from pyspark.sql import functions as F

    from sievemark.operators import limits

    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:00"), (3, "a", "2024-01-01 23:59:59"), (4, "a", "2024-01-02 00:00:00"), (5, None, "2024-01-01 10:00:30"), (6, None, "2024-01-01 10:00:10"), (7, "b", None), (8, "b", None)]
    d = spark.createDataFrame(rows, "id long, k string, s string").withColumn("ts", F.col("s").cast("timestamp"))
    assert {r.id: r.seen for r in limits.campaign(d, "k", "ts", "id").collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 1, 7: 1, 8: 2}
    assert limits.campaign(d.where("false"), "k", "ts", "id").count() == 0


def test_other_streams_equal_plain_counts(spark, tmp_path):
    """Campaigns, latency by day, sessions, brute force and alerts once, from a stream of files against the same rows in batch."""
    from sievemark.streaming import checks

    rows = [(i, i % 3, f"2024-01-0{1 + i % 2} 0{i % 4}:{i % 60:02d}:00", float(i), f"k{i % 5}") for i in range(60)]
    rows += [(100, 9, "2024-01-09 00:00:00", 1.0, "late")]  # moves the watermark past the others
    d = spark.createDataFrame(rows, "id int, who int, ts string, value double, key string").withColumn("ts", F.to_timestamp("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "rows"))
    read = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "rows"))
    early = d.where("id < 100")
    day = F.date_trunc("day", "ts").alias("day")
    cases = {
        "campaigns": (checks.daily_campaigns(read(), "who"), early.groupBy(day, F.col("who").alias("fingerprint")).agg(F.count("*").alias("seen")).where("seen >= 3").select("day", "fingerprint", "seen", F.lit(limits.CAMPAIGN_PENALTY))),
        "latency": (checks.daily_latency(read(), "who").select("day", "stage", "samples", "mean"), early.groupBy(day, F.col("who").alias("stage")).agg(F.count("*"), F.avg("value"))),
        "sessions": (checks.activity_sessions(read(), "who"), early.groupBy(F.session_window("ts", "1 hour").alias("w"), "who").agg(F.count("*").alias("n")).select("who", "w.start", "w.end", "n")),
        "force": (checks.brute_force(read(), "who", least=2, seconds=600), early.groupBy(F.window("ts", "600 seconds", "100 seconds").alias("w"), "who").agg(F.count("*").alias("n")).where("n >= 2").select("who", "w.start", "w.end", "n")),
    }
    for name, (made, batch) in cases.items():
        q = made.writeStream.format("memory").queryName(f"other_{name}").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(map(tuple, spark.table(f"other_{name}").collect()))
        assert got == sorted(map(tuple, batch.collect())) and got, name
    q = checks.once(read(), "key").writeStream.format("memory").queryName("other_once").option("checkpointLocation", str(tmp_path / "cp_once")).trigger(availableNow=True).start()
    q.awaitTermination()
    keys = [r.key for r in spark.table("other_once").collect()]
    assert sorted(keys) == sorted({r[4] for r in rows})


def test_brute_force_and_alerts_once_where_rows_fall_together(spark, tmp_path):
    """As above, with rejections of one address within ten minutes, so that windows have something in them."""
    from sievemark.streaming import checks

    rows = [(i, i % 3, f"2024-01-01 0{i % 4}:{i // 4:02d}:00", f"k{i % 5}") for i in range(60)]
    rows += [(100, 9, "2024-01-09 00:00:00", "late")]  # moves the watermark past the others
    d = spark.createDataFrame(rows, "id int, who int, ts string, key string").withColumn("ts", F.to_timestamp("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "rows"))
    read = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "rows"))
    held = {}
    for name, made in {"force": checks.brute_force(read(), "who", least=2, seconds=600), "once": checks.once(read(), "key")}.items():
        made.writeStream.format("memory").queryName(f"together_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        held[name] = spark.table(f"together_{name}").collect()
    want = d.where("id < 100").groupBy(F.window("ts", "600 seconds", "100 seconds").alias("w"), "who").agg(F.count("*").alias("n")).where("n >= 2").select("who", "w.start", "w.end", "n")
    assert sorted(map(tuple, held["force"])) == sorted(map(tuple, want.collect())) and held["force"]
    assert sorted(r.key for r in held["once"]) == sorted({r[3] for r in rows})
