"""Exact dedup by progressive refinement (DataFrame functions only).

Level 1 groups texts by length, level 2 by length and a hash of a prefix, level
3 by a SHA-256 of the whole text. After each of the first two levels the keys
that occur more than once are folded into a bitmap; a row whose key is not in it
is unique and no later level looks at it. The bitmap is broadcast: its size is
fixed by ``bitmap_bits`` (64 MB at most, however many rows there are), and a false hit
only sends a unique row on to the next level. Texts are never shuffled for
finding groups; only hashes and ids are.

Defined results: a null text counts as the empty text; a null id ranks below
every id; of repeated rows (same id, same text) one stays; an empty table gives
an empty result; further columns of any name and type pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_bits, lookup, mark, table, unwrap, wrap

#: Characters that level 2 hashes.
PREFIX = 256


def _repeated(keys: DataFrame, bits: int) -> DataFrame:
    """Bitmap of the values of column ``h`` that occur more than once."""
    return bitmap(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), bits)


def _candidates(rows: DataFrame, prefix: int) -> DataFrame:
    """Rows (with a column ``text``) and ``bytes``, ``head`` and ``open``: whether levels 1 and 2 leave it open that the text has a copy."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = bitmap_bits(rows.count())
    length, head = F.xxhash64(F.octet_length(text)), F.xxhash64(F.octet_length(text), F.substring(text, 1, prefix))
    by_length = _repeated(rows.select(length.alias("h")), bits)
    level_2 = mark(rows.select(length.alias("l"), head.alias("h")), F.col("l"), by_length, bits, "open").where("open").select("h")
    by_head = _repeated(level_2, bits)
    marked = rows.withColumns({"bytes": F.octet_length(text).cast("bigint"), "head": head})
    return mark(marked, F.col("head"), by_head, bits, "open")


def _full() -> F.Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns: of each group of equal texts the one with the largest id.

    Of rows that share id and text that with the largest hash of all its columns stays, so that reruns agree.
    """
    seen = _candidates(wrap(docs, id=F.col(id_col), text=F.col(text_col)), prefix)
    tie = F.xxhash64(F.col("whole").cast("string"))  # a map column can be neither compared nor hashed itself
    best = seen.where("open").groupBy("bytes", "head", _full().alias("full")).agg(F.max_by("whole", F.struct("id", tie)).alias("whole"))
    return unwrap(seen.where("not open").select("whole").unionByName(best.select("whole")), docs.columns)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), prefix: int = PREFIX) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and the columns named in ``carry``."""
    carried = [F.col("carried")[c].alias(c) for c in carry]
    held = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    seen = _candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("carried")), prefix)
    out = [F.col("id").alias(id_col), "keep_id", "group_size", "kept"]
    one = seen.where("not open").select("id", "carried", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    open_rows = table(seen.where("open").select("id", F.monotonically_increasing_id().alias("row"), "bytes", "head", _full().alias("full"), "carried"), "exact-open")
    keys = ["bytes", "head", "full"]
    top = open_rows.groupBy(*keys).agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size"))
    top = top.select(*keys, F.col("top.id").alias("keep_id"), F.col("top.row").alias("top_row"), "group_size", F.col("group_size").alias("rows"))
    many = lookup(open_rows, top, keys, "rows", open_rows.count())
    many = many.select("id", "carried", "keep_id", "group_size", (F.col("row") == F.col("top_row")).alias("kept"))
    return one.unionByName(many).select(*out, *carried)
