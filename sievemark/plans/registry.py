"""Registered queries: name -> (function of session and table folder, SQL or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables of long texts, where the work is in the rows.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(d) if name in TEXTS else d


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file over all cores; a table that already has a partition for each is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: ``now`` of the queries over orders and over events.
ORDERS_NOW, EVENTS_NOW = "1998-08-02 00:00:00", "2024-01-31 00:00:00"


def orders_now() -> Column:
    return F.lit(ORDERS_NOW).cast("timestamp")


def events_now() -> Column:
    return F.lit(EVENTS_NOW).cast("timestamp")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders standing in for scored reports."""
    o = read(spark, sf_dir, "orders")
    score = ((F.col("o_orderkey") * 37 + F.col("o_custkey") * 11) % 101).cast("bigint")
    d = o.select(
        F.col("o_orderkey").alias("report_id"), score.alias("score"), F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 3).cast("bigint").alias("matches"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("mode"), F.col("o_custkey").alias("visitor"),
    )
    c = 100 - F.col("score")
    label = F.when(c >= 80, "STRONG").when(c >= 65, "PROMISING").when(c >= 50, "REASONABLE").when(c >= 35, "NEEDS REVIEW").when(c >= 20, "LIKELY INVALID").otherwise("HIGH RISK")
    return d.withColumn("composite", c).withColumn("label", label)


SCORED = """(
    SELECT o_orderkey AS report_id, CAST((o_orderkey * 37 + o_custkey * 11) % 101 AS BIGINT) AS score, o_orderpriority AS family, CAST(o_custkey % 3 AS BIGINT) AS matches,
           o_orderdate AS created_at, o_orderstatus AS mode, o_custkey AS visitor, 100 - CAST((o_orderkey * 37 + o_custkey * 11) % 101 AS BIGINT) AS composite,
           CASE WHEN 100 - (o_orderkey * 37 + o_custkey * 11) % 101 >= 80 THEN 'STRONG' WHEN 100 - (o_orderkey * 37 + o_custkey * 11) % 101 >= 65 THEN 'PROMISING'
                WHEN 100 - (o_orderkey * 37 + o_custkey * 11) % 101 >= 50 THEN 'REASONABLE' WHEN 100 - (o_orderkey * 37 + o_custkey * 11) % 101 >= 35 THEN 'NEEDS REVIEW'
                WHEN 100 - (o_orderkey * 37 + o_custkey * 11) % 101 >= 20 THEN 'LIKELY INVALID' ELSE 'HIGH RISK' END AS label
    FROM orders)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines standing in for feedback on reports."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("feedback_id"), F.col("l_orderkey").alias("report_id"), (F.col("l_partkey") % 5 + 1).cast("bigint").alias("rating"),
        (F.col("l_suppkey") % 3 != 0).alias("helpful"), F.col("l_shipdate").alias("created_at"),
    )


FEEDBACK = """(
    SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS feedback_id, l_orderkey AS report_id, CAST(l_partkey % 5 + 1 AS BIGINT) AS rating, l_suppkey % 3 <> 0 AS helpful, l_shipdate AS created_at
    FROM lineitem)"""

RATED = f"(SELECT f.*, s.score, s.family FROM {FEEDBACK} f JOIN {SCORED} s USING (report_id))"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback(spark, sf_dir).join(scored(spark, sf_dir).select("report_id", "score", "family"), "report_id")


TIER = "CASE WHEN {0} >= 80 THEN 'Slop' WHEN {0} >= 60 THEN 'Likely Slop' WHEN {0} >= 40 THEN 'Questionable' WHEN {0} >= 20 THEN 'Likely Human' ELSE 'Clean' END"
BAND = "CASE WHEN {0} <= 20 THEN '0-20' WHEN {0} <= 40 THEN '21-40' WHEN {0} <= 60 THEN '41-60' WHEN {0} <= 80 THEN '61-80' ELSE '81-100' END"


def d_rate(part: str, whole: str, places: int) -> str:
    k = 10**places
    return f"(CASE WHEN {whole} > 0 THEN floor(CAST({part} AS DOUBLE) / {whole} * {k} + 0.5) / {k} ELSE 0.0 END)"
