"""Writers: partitioned tables, insert-if-absent, pruning, guarded updates, counters recomputed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Parquet by UTC day. Rows are dealt by day and a hash of the row, so a busy day is written by several tasks, and a day's files stay few."""
    day = df.withColumn("day", F.to_date(ts))
    day.repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode(mode).partitionBy("day").parquet(path)


def absent(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet, each key once: insert-or-ignore."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def insert_absent(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    spark = new.sparkSession
    absent(new, spark.read.parquet(path), keys).write.mode("append").parquet(path)


def update(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], guard: Column | None = None) -> DataFrame:
    """``df`` with ``columns`` taken from ``changes`` (one row per key) where the key matches and ``guard`` holds."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    ok = F.col("__hit") if guard is None else F.col("__hit") & guard
    j = df.join(new, key, "left")
    for c in columns:
        j = j.withColumn(c, F.when(F.coalesce(ok, F.lit(False)), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return j.select(*df.columns)


def counters(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Counter table (key, value), recomputed from rows rather than kept."""
    one = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in counts])))


def replace_days(df: DataFrame, path: str, ts: str) -> None:
    """Overwrite only the days that ``df`` has rows of (retention: write the survivors back)."""
    day = df.withColumn("day", F.to_date(ts))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
