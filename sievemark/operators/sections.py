"""Sections of a text, their hashes, and joins on them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java, normalise

#: Words in titles. Fixed values.
HIGH = ("vulnerability", "description", "summary", "impact", "severity", "steps to reproduce", "reproduction", "poc", "proof of concept", "exploit", "payload", "attack",
        "technical details", "details", "root cause", "remediation", "mitigation", "fix", "recommendation")
MEDIUM = ("environment", "setup", "configuration", "prerequisites", "affected", "scope", "references", "timeline", "disclosure", "expected behavior", "observed behavior", "actual behavior")
#: Title of a paragraph by its first 100 characters, first hit wins. Fixed values.
LABELS = (
    (r"(?:vulnerability|description|summary|overview)", "Description"),
    (r"(?:step|reproduce|poc|proof)", "Reproduction Steps"),
    (r"(?:impact|severity|risk|consequence)", "Impact Assessment"),
    (r"(?:fix|remediat|mitigat|patch|recommend)", "Remediation"),
    (r"(?:code|payload|exploit|script|curl|http)", "Technical Details"),
)
WHOLE = "Full Report"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def weight(title: Column) -> Column:
    low = F.lower(title)
    any_of = lambda words: low.rlike("|".join(words))
    return F.when(any_of(HIGH), 3).when(any_of(MEDIUM), 2).otherwise(1).cast("bigint")


def section_hash(content: Column) -> Column:
    return F.sha2(normalise(content).cast("binary"), 256)


def sections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ord, title, section_key, section_hash, weight).

    Markdown headers (``#`` to ``####``) cut a text where it has any: what is
    before the first is a preamble if over 20 characters, bodies of ten or fewer
    are left out. Otherwise paragraphs over ten characters are sections named by
    their first words; with at most one, the whole text is the section. The key is
    the title, numbered where it repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    header = java(r"^#{1,4}\s+.+$", "m")
    cut = F.split(text, java(r"^(?=#{1,4}\s+.+$)", "m"))
    body = lambda p: strip(F.regexp_replace(p, java(r"^#{1,4}\s+.+"), ""))
    named = F.transform(
        cut,
        lambda p: F.when(p.rlike(java(r"^#{1,4}\s+.")), F.struct(strip(F.regexp_extract(p, java(r"^#{1,4}\s+(.+)"), 1)).alias("title"), body(p).alias("content"), F.lit(10).alias("least")))
        .otherwise(F.struct(F.lit("Preamble").alias("title"), strip(p).alias("content"), F.lit(20).alias("least"))),
    )
    by_header = F.transform(F.filter(named, lambda s: F.length(s["content"]) > s["least"]), lambda s: F.struct(s["title"].alias("title"), s["content"].alias("content"), F.when(s["title"] == "Preamble", F.lit(1).cast("bigint")).otherwise(weight(s["title"])).alias("weight")))
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: F.length(p) > 10)

    def label(p: Column, i: Column) -> Column:
        head = F.substring(p, 1, 100)
        out = F.concat(F.lit("Section "), (i + 1).cast("string"))
        for pattern, name in reversed(LABELS):
            out = F.when(head.rlike(f"(?i){pattern}"), name).otherwise(out)
        return out

    several = F.transform(paragraphs, lambda p, i: F.struct(label(p, i).alias("title"), p.alias("content"), weight(label(p, i)).alias("weight")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("title"), text.alias("content"), F.lit(2).cast("bigint").alias("weight")))
    found = F.when(text.rlike(header), by_header).when(F.size(paragraphs) <= 1, whole).otherwise(several)
    rows = df.select(F.col(id_col), found.alias("s"))
    titles = F.transform("s", lambda s: s["title"])
    numbered = F.transform(
        "s",
        lambda s, i: F.struct(
            s["title"].alias("title"), s["content"].alias("content"), s["weight"].alias("weight"),
            F.size(F.filter(F.slice(F.col("titles"), 1, i + 1), lambda t: t == s["title"])).alias("n"),
        ),
    )
    flat = rows.withColumn("titles", titles).select(id_col, F.posexplode(numbered).alias("ord", "s"))
    key = F.when(F.col("s.n") > 1, F.concat(F.col("s.title"), F.lit(" ("), F.col("s.n").cast("string"), F.lit(")"))).otherwise(F.col("s.title"))
    return flat.select(id_col, F.col("ord").cast("bigint").alias("ord"), F.col("s.title").alias("title"), key.alias("section_key"), section_hash(F.col("s.content")).alias("section_hash"), F.col("s.weight").alias("weight"))


def section_matches(queries: DataFrame, corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Equal sections of other rows: query_id, section, match_id, match_section, similarity (100)."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col("section_key").alias("section"), "section_hash")
    c = corpus.select(F.col(id_col).alias("match_id"), F.col("section_key").alias("match_section"), "section_hash")
    return q.join(c, "section_hash").where("query_id <> match_id").select("query_id", "section", "match_id", "match_section", F.lit(100).cast("bigint").alias("similarity"))


def compare(pairs: DataFrame, parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sections of both rows of each pair (a_id, b_id), side by side: identical, different or unique."""
    side = lambda k: pairs.join(parts.select(F.col(id_col).alias(f"{k}_id"), "section_key", F.col("section_hash").alias(f"{k}_hash")), f"{k}_id")
    both = side("a").join(side("b"), ["a_id", "b_id", "section_key"], "full_outer")
    status = F.when(F.col("a_hash") == F.col("b_hash"), "identical").when(F.col("a_hash").isNotNull() & F.col("b_hash").isNotNull(), "different").otherwise("unique")
    return both.select("a_id", "b_id", "section_key", status.alias("status"), "a_hash", "b_hash")


def structure(text: str | Column) -> Column:
    """Hash of a text's skeleton: headers, paragraph lengths (xs/s/m/l/xl) and whether it has code, numbered steps or bullets.

    A line state machine, so an Arrow-batched function.
    """
    top = re.compile(r"#{1,6}\s+(.+)")
    #: Words below which a paragraph has a size. Fixed values.
    sizes = ((30, "xs"), (80, "s"), (160, "m"), (320, "l"))
    size = lambda n: next((k for below, k in sizes if n < below), "xl")

    def one(t: str | None) -> str:
        heads, lengths, words, marks, fenced = [], [], 0, set(), False
        for line in (x.strip() for x in re.split(r"\r?\n", t or "")):
            if line.startswith("```"):
                marks.add("c")
                fenced = not fenced
            elif fenced:
                continue
            elif line and not (head := top.fullmatch(line)):
                marks |= {k for k, p in (("n", r"\d+[.)]\s+"), ("b", r"[-*+]\s+")) if re.match(p, line)}
                words += len(line.split())
            else:  # a blank line or a header ends a paragraph
                if words:
                    lengths.append(size(words))
                words = 0
                if line:
                    heads.append(re.sub(r"[^a-z0-9 ]", "", head[1].lower()).strip())
        if words:
            lengths.append(size(words))
        shape = f"H:{'>'.join(heads)}|P:{','.join(lengths)}|F:{''.join(k for k in 'cnb' if k in marks)}"
        return hashlib.sha256(shape.encode("utf-8", "surrogatepass")).hexdigest()[:32]

    @F.pandas_udf("string")
    def skeleton(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one, na_action=None)

    return skeleton(F.col(text) if isinstance(text, str) else text)
