"""Shared helpers: work tables in the shared folder, hashing, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as heavy when it holds more than this share of all rows, so
#: there are never more than ``1 / HEAVY_SHARE`` heavy keys to broadcast.
HEAVY_SHARE = 1 / 500

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset a local
    session (tests) gets a temporary folder, set as checkpoint folder; on a
    cluster it is an error, since executors would not share such a folder.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="sievemark-")
        spark.conf.set("spark.checkpoint.dir", set_to)
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor never recomputes what is above, and two
    readers do not run it twice. :func:`drop` removes it when nothing reads it
    any more, :func:`release` removes all that are left.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    _made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sievemark_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`table`."""
    for t in tables:
        path = getattr(t, "_sievemark_path", None)
        if path:
            delete(t.sparkSession, path)


def mark_tables() -> int:
    """Number of the next work table, for :func:`release`."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Delete the work tables made since but for those in ``keep``, once their readers' results are written."""
    kept = {getattr(t, "_sievemark_path", None) for t in keep}
    for path in _made[since:]:
        if path not in kept:
            delete(spark, path)
    _made[since:] = [p for p in _made[since:] if p in kept]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def wrap(docs: DataFrame, **columns: F.Column) -> DataFrame:
    """``docs`` with all its columns in one, ``whole``, beside the named ones: whatever ``docs`` calls its columns, none clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *[c.alias(n) for n, c in columns.items()])


def unwrap(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that :func:`wrap` put into ``whole``."""
    return df.select(*[F.col("whole")[c].alias(c) for c in columns])


def few_texts(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str | None]]:
    """The values of a string column, about ``size`` bytes at a time: a batch has up to 10,000 texts, and objects of all at once stay in a worker's memory."""
    step = max(1, len(texts) * size // max(1, texts.nbytes))
    for at in range(0, len(texts), step):
        some = texts.slice(at, step)
        if some.nbytes > 4 * size and len(some) > 1:  # long texts beside each other
            yield from few_texts(some, size)
        else:
            yield some.to_pylist()


def giving_back(run: Callable) -> Callable:
    """The task ``run``; at its end the memory that Arrow keeps for later batches goes back. A worker that idles, or has other work next, would hold 100 MB of it."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return task


def crc_fold(doc_id) -> F.Column:
    """Fold of a document: crc32 of its id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def bitmap_bits(keys: int) -> int:
    """Size of a bitmap for about ``keys`` values: 8 to 16 bits each, at least 2**20, at most 2**29 (64 MB)."""
    return 1 << min(29, max(20, (8 * keys).bit_length()))


def bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """The values of the column ``h`` folded into a bitmap of fixed size, small enough to broadcast whatever their number."""
    at = F.pmod(F.col("h"), F.lit(bits)) + 1
    return table(
        hashes.select(F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at).alias("bit"))
        .groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__map")),
        "bitmap",
    )


def mark(df: DataFrame, h: F.Column, in_bitmap: DataFrame, bits: int, name: str) -> DataFrame:
    """Add boolean ``name``: whether the bit of ``h`` is set. It always is for a value in the bitmap; others hit by chance."""
    at = F.pmod(h, F.lit(bits)) + 1
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("__map"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(__bit % 8 as int)) & 1 = 1")
    out = df.withColumn("__at", F.bitmap_bucket_number(at)).join(F.broadcast(in_bitmap), F.col("__at") == F.col("__bucket"), "left")
    return out.withColumns({"__byte": byte, "__bit": bit}).withColumn(name, F.coalesce(hit, F.lit(False))).drop("__at", "__bucket", "__map", "__byte", "__bit")


class Bits:
    """A bitmap of bounded size (64 MB at most) for Python tasks to test hashes (a column ``h``) against."""

    def __init__(self, spark: SparkSession, hashes: DataFrame):
        self.bits = bitmap_bits(hashes.count())
        flat = np.zeros(self.bits // 8, np.uint8)
        for r in bitmap(hashes, self.bits).toLocalIterator():
            at = (r["__bucket"] - 1) * 4096
            part = np.frombuffer(bytes(r["__map"]), np.uint8)[: len(flat) - at]
            flat[at : at + len(part)] = part
        self.held = spark.sparkContext.broadcast(flat)

    def hit(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.int64) & np.int64(self.bits - 1)
        return (self.held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def __contains__(self, h: int) -> bool:
        at = h & (self.bits - 1)
        return bool(self.held.value[at >> 3] >> (at & 7) & 1)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: str, total: int) -> DataFrame:
    """Left rows with the columns of ``right``, which has one row per key.

    ``rows`` is a column of ``right`` with the number of left rows of its key
    and ``total`` their sum. Keys above ``HEAVY_SHARE`` of all rows are joined by
    broadcast: there are at most ``1 / HEAVY_SHARE`` of them whatever the size
    of the data. All others go through a shuffle in which no key holds more than
    that share. Left rows whose key is not in ``right`` are dropped; null keys
    match null keys.
    """
    limit = max(1, int(total * HEAVY_SHARE))
    heavy = right.where(F.col(rows) > limit)
    light = right.where(F.col(rows) <= limit)
    on = lambda r: [left[k].eqNullSafe(r[f"__{k}"]) for k in keys]
    under = lambda r: r.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in r.columns if c not in (*keys, rows)])
    h, li = under(heavy), under(light)
    marks = [f"__{k}" for k in keys]
    return (
        left.join(F.broadcast(h), _all(on(h))).drop(*marks)
        .unionByName(left.join(F.broadcast(h.select(*marks)), _all(on(h)), "left_anti").join(li, _all(on(li))).drop(*marks))
    )


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
