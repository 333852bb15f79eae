"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies,
target / size of the source. Its fractional part is a probability. Two
documents with fractional parts are paired and words of probability mass move
at random from one to the other until one of the two has none or a whole copy;
the words expected of the pair do not change. A task does this along its own
rows and keeps one unsettled document per source; these residuals meet in a
reduction tree, so the last one per source is all that is left. That one
document is taken in part, so a source misses its target by less than a word.

Random numbers come from hashes of seed, id, source and text, and rows are
settled in the order of such a hash, so reruns agree.

Defined results: a null or blank text has size 0 and takes 0; a null source is
a source of its own and comes last; repeated rows are separate rows; an empty
table gives an empty result; further columns of any name are ignored, or kept by
:func:`apply`.
"""

from __future__ import annotations

import hashlib
import math
import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, table, wrap

#: Relative weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the targets add up to.
SHARE = 1.5
#: Most copies of a source.
MOST = 2.0
#: Residual groups that meet in one group of the next level of the tree.
FAN_IN = 16
SEED = 20240229


def sizes(docs: DataFrame, text_col: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to rows (source, source_size).

    Sources are numbered in code point order (null last); target is weight times
    a level, at most ``most`` times the size, and the level is raised until the
    targets add up to ``share`` of all sizes. The level is found by rounds of one
    aggregate each: sources found above their cap are fixed there and the rest
    shared again, which ends when a round finds none.
    """
    # UTF-8 binary order is code point order.
    ranked = table(_ranked(per_source).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "mix-sources")
    whole = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]) * share
    level, was = 0.0, -1
    cap = F.lit(most) * F.col("source_size")
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        r = ranked.agg(F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, cap)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r["w"] or r["n"] == was:
            break
        was = r["n"]
        level = (whole - (r["fixed"] or 0.0)) / r["w"]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight")


def _ranked(per_source: DataFrame) -> DataFrame:
    """Number sources from 0 without one task seeing them all: rank in a range partition plus rows in those before."""
    key = [F.col("source").isNull(), F.col("source").cast("binary")]
    parts = table(per_source.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    # One row per partition of the range exchange: bounded by the number of shuffle partitions.
    return parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def _uniform(seed: int, *parts) -> float:
    h = hashlib.blake2b(struct.pack("<q", seed) + b"|".join(str(p).encode() for p in parts), digest_size=8).digest()
    return (int.from_bytes(h, "little") >> 11) / (1 << 53)


def _settle(rows: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """Pivot along ``rows`` of (row, size, mass): mass is the fractional part in words, 0 < mass < size.

    ``row`` is a pair of hashes: 128 bits, so no two rows of a source have the same.
    Returns settled (row, copies 0 or 1) and the one left over.
    """
    done, carry = [], None
    for row, size, mass in rows:
        if carry is None:
            carry = (row, size, mass)
            continue
        c_row, c_size, c_mass = carry
        up = min(c_size - c_mass, mass)  # words that can move to the carried one
        down = min(c_mass, size - mass)
        if _uniform(seed, c_row, row) * (up + down) < down:
            c_mass, mass = c_mass + up, mass - up
        else:
            c_mass, mass = c_mass - down, mass + down
        out = []
        for r, s, m in ((c_row, c_size, c_mass), (row, size, mass)):
            if m <= 1e-9 * s:
                done.append((r, 0.0))
            elif m >= s * (1 - 1e-9):
                done.append((r, 1.0))
            else:
                out.append((r, s, m))
        carry = out[0] if out else None
    return done, carry


def _round(frame: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: settle each (source, part) group."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "twin"])
        src, parts = int(pdf["src"].iloc[0]), int(pdf["parts"].iloc[0])
        rows = list(zip(pdf["row"], pdf["twin"]))
        done, left = _settle(list(zip(rows, pdf["size"], pdf["mass"])), seed)
        size = dict(zip(rows, pdf["size"]))
        out = [(src, *r, size[r], c * size[r], parts, True) for r, c in done]
        if left:
            out.append((src, *left[0], left[1], left[2], parts, False))
        return pd.DataFrame(out, columns=["src", "row", "twin", "size", "mass", "parts", "settled"])

    return frame.groupBy("src", "part").applyInPandas(settle, "src long, row long, twin long, size double, mass double, parts long, settled boolean")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, rows_per_group: int = 4000) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target (its source's), taken (words, repeats counted)."""
    base = table(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), sizes(docs, text_col).alias("size"),
                    F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
        .groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("times"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(times - 1) div 10000"))))  # no array over 10,000 however often a row is repeated
        .withColumn("copy", F.explode(F.sequence(F.col("block") * 10_000, F.least(F.col("times"), (F.col("block") + 1) * 10_000) - 1)))
        .withColumn("row", F.xxhash64("doc_id", "source", "h", "copy", F.lit(seed)))
        .withColumn("twin", F.xxhash64(F.lit(seed), "copy", "h", "source", "doc_id", "size")).drop("h", "times", "block", "copy"),
        "mix-rows",
    )
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = table(targets(per_source, weights, share, most).withColumnRenamed("rank", "src").withColumn("rows", F.col("n")), "mix-targets")
    r = goal.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = table(lookup(base, goal, ["source"], "rows", r["total"]).withColumn("x", ratio), "mix-expected")
    # Groups of a source: its rows over rows_per_group, then over FAN_IN at each level of the tree.
    group = lambda n: F.pmod(F.xxhash64("row", n), n).cast("bigint")
    parts, most_parts = F.ceil(F.col("n") / rows_per_group).cast("bigint"), math.ceil(r["largest"] / rows_per_group)
    todo = rows.where((F.col("x") % 1 > 1e-12) & (F.col("size") > 0)).select(
        "src", "row", "twin", F.col("size").cast("double").alias("size"), (F.col("size") * (F.col("x") % 1)).alias("mass"), parts.alias("parts")
    ).withColumn("part", group(F.col("parts")))
    got = None
    while True:
        level = table(_round(todo, seed), "mix-level")
        settled = level.where("settled").select("src", "row", "twin", "mass")
        got = settled if got is None else got.unionByName(settled)
        left = level.where("not settled")
        if most_parts <= 1:
            got = got.unionByName(left.select("src", "row", "twin", F.round("mass").alias("mass")))
            break
        most_parts = math.ceil(most_parts / FAN_IN)
        todo = left.select("src", "row", "twin", "size", "mass", F.ceil(F.col("parts") / FAN_IN).cast("bigint").alias("parts")).withColumn("part", group(F.col("parts")))
    words = F.floor("x") * F.col("size") + F.coalesce(F.round("mass"), F.lit(0.0))
    return rows.join(got, ["src", "row", "twin"], "left").select("doc_id", "source", "size", "source_size", "target", words.cast("bigint").alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each copy; the copy taken in part has its first words only."""
    plan = mix(docs, id_col, text_col, source_col, **parameters)
    want = plan.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("planned")).where("taken > 0")
    want = table(want.withColumnsRenamed({"doc_id": "id", "source": "of", "size": "each_size"}), "mix-wanted")
    sized = wrap(docs, number=F.col(id_col), source=F.col(source_col), text=F.col(text_col), words=sizes(docs, text_col), row=F.monotonically_increasing_id())
    on = F.col("number").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("words") == F.col("each_size"))
    out = sized.join(want.where("planned = 1"), on).withColumn("each", F.col("taken"))
    if not want.where("planned > 1").isEmpty():  # repeated rows share whole copies of what is taken of them, the next one gets the rest
        whole, rest = F.expr("taken div each_size"), F.col("taken") % F.col("each_size")
        more = F.when(F.col("nth") <= whole % F.col("planned"), F.col("each_size")).when(F.col("nth") == whole % F.col("planned") + 1, rest).otherwise(0)
        share = F.floor(whole / F.col("planned")) * F.col("each_size") + more
        alike = _numbered(sized.join(want.where("planned > 1"), on), ["id", "of", "each_size"])
        out = out.unionByName(alike.withColumn("each", share).drop("nth"))
    part = F.expr("cast(each % each_size as int)")
    copies = F.concat(F.array_repeat(F.lit(-1), F.expr("cast(each div each_size as int)")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    pieces = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    out = out.withColumn("copy", F.explode(copies))
    text = F.when(F.col("copy") < 0, F.col("text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.abs("copy")), ""))
    return out.select(*[text.alias(c) if c == text_col else F.col("whole")[c].alias(c) for c in docs.columns])


#: Parts that the rows of a key are dealt to for numbering.
DEALT = 64


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``nth``: a number from 1 within the key. The rows of a key are dealt to parts that follow each other, by a hash
    with the row's number in it (rows may be all alike); each part is numbered by itself and those before are added up from
    one row a part, so no task orders a whole key."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("text", "row"), F.lit(DEALT)))
    count = dealt.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = count.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.xxhash64("text"), "row"))
    same = F.col("part") == F.col("p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}"))
    return dealt.withColumn("own", own).join(before, same).withColumn("nth", F.col("own") + F.col("before")).drop("part", "own", "p", "before", *[f"k{i}" for i in range(len(keys))])
