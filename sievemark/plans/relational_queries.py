"""Queries over stored rows: feeds, look-ups, joins, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rl
from .registry import ORDERS_NOW, SCORED, query, read, scored

_FILTER = "family IN ('1-URGENT', '2-HIGH') AND score >= 40 AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '1997-01-01'"


def _filtered(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rl.where_all(s, {"family": ["1-URGENT", "2-HIGH"], "mode": None}, {"created_at": ("1995-01-01", "1997-01-01"), "score": (40, None)}, default={"family": "FLAT"})


@query(f"SELECT report_id, score, place, more FROM (SELECT report_id, score, row_number() OVER (ORDER BY score DESC, report_id DESC) AS place, count(*) OVER () > 60 AS more FROM {SCORED} WHERE {_FILTER}) WHERE place > 40 AND place <= 60")
def feed_page(spark, sf_dir):
    return rl.feed(_filtered(spark, sf_dir), "report_id", "highest", 40, 20).select("report_id", "score", "place", "more")


@query(f"SELECT count(*) AS total FROM {SCORED} WHERE {_FILTER}")
def feed_total(spark, sf_dir):
    return rl.total(_filtered(spark, sf_dir))


@query("SELECT o_orderkey, 'VR-' || CASE WHEN length(upper(to_hex(o_orderkey))) < 4 THEN lpad(upper(to_hex(o_orderkey)), 4, '0') ELSE upper(to_hex(o_orderkey)) END AS code FROM orders")
def report_codes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", rl.code(F.col("o_orderkey")).alias("code"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type ILIKE '%UR%' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_page(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    e = rl.where_all(e, between={"ts": ("2024-01-10", "2024-01-12")}, like={"event_type": "UR"})
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "user_id")


@query("""
    WITH h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) - 1 AS step, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS score FROM lineitem)
    SELECT l_orderkey, step, line, score, score - lag(score) OVER (PARTITION BY l_orderkey ORDER BY step) AS change, o_orderdate AS created_at FROM h LEFT JOIN orders ON o_orderkey = l_orderkey""")
def score_history(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("bigint").alias("score")))).alias("h"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("created_at"))
    return rl.history(l, "l_orderkey", "h").join(o, "l_orderkey", "left")


@query("SELECT l_orderkey, count(*) AS matches, count(*) FILTER (l_quantity >= 40) AS near, CAST(max(l_quantity) AS BIGINT) AS best FROM lineitem GROUP BY 1")
def verification_badge(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("bigint")).alias("m"))
    return rl.badge(l, "l_orderkey", "m", 40)


@query("""
    SELECT l_orderkey, l_linenumber, hours, signal, weight FROM (
        SELECT l_orderkey, l_linenumber, CASE WHEN h < 24 THEN floor(h * 10 + 0.5) / 10 ELSE floor(h + 0.5) END AS hours, CASE WHEN h < 2 THEN 'suspiciously_fast' WHEN h < 24 THEN 'fast_turnaround' ELSE 'normal' END AS signal,
               CAST(CASE WHEN h < 2 THEN 12 WHEN h < 24 THEN 5 ELSE 0 END AS BIGINT) AS weight
        FROM (SELECT l_orderkey, l_linenumber, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 AS h FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE h >= 0)""")
def temporal_signals(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return rl.publication_signals(read(spark, sf_dir, "lineitem"), o, "l_orderkey", "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber", "hours", "signal", "weight")


@query("SELECT r_name AS family, string_agg(n_name, ',' ORDER BY n_name) AS members, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cwe_catalog(spark, sf_dir):
    """Catalogue entries by family (nations by region stand in)."""
    j = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("family")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("members"), F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def already_promoted(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def never_submitted(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query(f"SELECT visitor, day, count FROM (SELECT visitor, CAST(created_at AS DATE) AS day, count(*) AS count FROM {SCORED} WHERE created_at <= TIMESTAMP '{ORDERS_NOW}' GROUP BY 1, 2)")
def visits_by_day(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("created_at") <= F.lit(ORDERS_NOW).cast("timestamp"))
    return s.groupBy("visitor", F.to_date("created_at").alias("day")).agg(F.count("*").alias("count"))


@query("""
    WITH l AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_linenumber = 1), r AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_linenumber = 7)
    SELECT coalesce(l.k, r.k) AS k, l.p AS first, r.p AS seventh, CASE WHEN l.p = r.p THEN 'identical' WHEN l.p IS NOT NULL AND r.p IS NOT NULL THEN 'different' ELSE 'unique' END AS status FROM l FULL JOIN r ON l.k = r.k""")
def full_outer_compare(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    side = lambda n, name: l.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias(name))
    j = side(1, "first").join(side(7, "seventh"), "k", "full_outer")
    return j.withColumn("status", F.when(F.col("first") == F.col("seventh"), "identical").when(F.col("first").isNotNull() & F.col("seventh").isNotNull(), "different").otherwise("unique"))
