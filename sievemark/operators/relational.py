"""Filters, feeds, look-ups and histories over stored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sort modes of the feed; the id breaks ties.
SORTS = {"newest": ("created_at", False), "oldest": ("created_at", True), "highest": ("score", False), "lowest": ("score", True)}


def where_all(df: DataFrame, equal: Mapping[str, object] | None = None, between: Mapping[str, tuple] | None = None, like: Mapping[str, str] | None = None, default: Mapping[str, object] | None = None) -> DataFrame:
    """Conjunction of the filters that are given; ``default`` names what a null column counts as. All reach the scan where the source allows."""
    tests: list[Column] = []
    value = lambda c: F.coalesce(F.col(c), F.lit(default[c])) if default and c in default else F.col(c)
    for c, v in (equal or {}).items():
        if v is not None:
            tests.append(value(c).isin(*v) if isinstance(v, (list, tuple, set)) else value(c) == v)
    for c, (low, high) in (between or {}).items():
        tests += [F.col(c) >= low] if low is not None else []
        tests += [F.col(c) < high] if high is not None else []
    for c, v in (like or {}).items():
        tests.append(F.col(c).ilike(f"%{v}%"))
    for t in tests:
        df = df.where(t)
    return df


def feed(df: DataFrame, id_col: str, sort: str = "newest", offset: int = 0, limit: int = 20) -> DataFrame:
    """One page (a top-k report) with the rows' place and whether more follow."""
    column, up = SORTS[sort]
    order = [F.col(column).asc() if up else F.col(column).desc(), F.col(id_col).asc() if up else F.col(id_col).desc()]
    page = df.orderBy(*order).limit(offset + limit + 1)
    w = Window.orderBy(*order)  # over the page, not the table
    ranked = page.withColumn("place", F.row_number().over(w).cast("bigint")).withColumn("more", F.count("*").over(Window.partitionBy()) > offset + limit)
    return ranked.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def code(id_col: Column, prefix: str = "VR-") -> Column:
    """Public code of an id: hexadecimal, four places at least."""
    h = F.hex(id_col)
    return F.concat(F.lit(prefix), F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h))


def history(df: DataFrame, id_col: str, entries: str) -> DataFrame:
    """Rows of a history array in order: (id, step, entry fields, change against the step before)."""
    flat = df.select(id_col, F.posexplode(entries).alias("step", "e")).select(id_col, F.col("step").cast("bigint").alias("step"), "e.*")
    return flat.withColumn("change", F.col("score") - F.lag("score").over(Window.partitionBy(id_col).orderBy("step")))


def badge(df: DataFrame, id_col: str, matches: str, high: int = 80) -> DataFrame:
    """Counts of a row's matches, near ones and the best."""
    return df.select(id_col, F.size(matches).cast("bigint").alias("matches"), F.size(F.filter(matches, lambda m: m >= high)).cast("bigint").alias("near"), F.coalesce(F.array_max(matches), F.lit(0)).cast("bigint").alias("best"))


def publication_signals(df: DataFrame, published: DataFrame, key: str, ts: str, at: str) -> DataFrame:
    """Hours from publication (key, ``at``) to submission: suspiciously fast under 2, fast under 24; earlier submissions give none."""
    from ..functions.text import rnd, seconds

    j = df.join(published, key).withColumn("h", (seconds(ts) - seconds(at)) / 3600).where("h >= 0")
    fast, quick = F.col("h") < 2, F.col("h") < 24
    return j.withColumn("hours", F.when(quick, rnd(F.col("h"), 1)).otherwise(rnd(F.col("h"), 0))).withColumn("signal", F.when(fast, "suspiciously_fast").when(quick, "fast_turnaround").otherwise("normal")).withColumn("weight", F.when(fast, 12).when(quick, 5).otherwise(0).cast("bigint"))


def scrub(df: DataFrame, public: Sequence[str]) -> DataFrame:
    """Only the columns that may be shown, of those that are there."""
    return df.select(*[c for c in public if c in df.columns])


def containing(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose array has all the values; an array in JSON text is parsed. No value at all: every row with an array. A null array contains nothing."""
    a = F.from_json(column, "array<string>") if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    test = a.isNotNull()
    for v in values:
        test = test & F.array_contains(a, F.lit(v))
    return df.where(F.coalesce(test, F.lit(False)))


def with_type(df: DataFrame, entries: str, prefix: str) -> DataFrame:
    """Rows with an entry (a struct with ``type``) whose type starts with ``prefix``, every character of it taken as it is."""
    return df.where(F.coalesce(F.exists(entries, lambda e: F.coalesce(e["type"].startswith(prefix), F.lit(False))), F.lit(False)))


def paged(df: DataFrame, id_col: str, size: int = 50_000) -> DataFrame:
    """Every row's page and place in it (from 1), in the order of integer ids without repeats.

    Rows are numbered within slots of ``size`` ids, so no group has more than
    ``size`` rows; what runs over all is only the count of each slot.
    """
    slot = F.floor(F.col(id_col) / size).cast("bigint")
    counts = df.groupBy(slot.alias("__slot")).agg(F.count("*").alias("__n"))
    w = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__slot", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    ranked = df.withColumn("__slot", slot).join(before, "__slot")
    at = F.col("__before") + F.row_number().over(Window.partitionBy("__slot").orderBy(id_col)) - 1
    return ranked.withColumn("page", F.floor(at / size).cast("bigint") + 1).withColumn("place", (at % size).cast("bigint") + 1).drop("__slot", "__before")
