"""Sanitising and redacting text: a fixed order of native regular-expression steps, so one scan and no shuffle.

Null text is treated as empty by :func:`redact` and stays null in the sanitisers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction_rules import GUARDS, INJECTION, INJECTION_CHARS, INJECTION_MARK, NAMED, PLACEHOLDER, PLACEHOLDERS, PRIVATE
from ..functions.text import count, every, java, let, swap

MAX_INPUT = 5 * 1024 * 1024
MAX_ANALYSIS = 50_000
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def sanitise(text: str | Column) -> Column:
    """Input as it is stored: active content marked, control characters out, long blanks and line runs cut, trimmed."""
    out = F.substring(F.col(text) if isinstance(text, str) else text, 1, MAX_INPUT)
    for pattern, to in (
        (r"<script[\s\S]*?</script>", "[removed-script]"),
        (r"<style[\s\S]*?</style>", "[removed-style]"),
        (r"on\w+\s*=\s*[\"'][^\"']*[\"']", "[removed-event-handler]"),
        (r"javascript\s*:", "[removed-js-uri]"),
        (r"data\s*:\s*text/html", "[removed-data-uri]"),
    ):
        out = swap(out, pattern, to, "i")
    out = swap(out, _CONTROL, "")
    out = swap(out, r"[ \t]{20,}", " " * 20)
    out = swap(out, r"(\r?\n){10,}", "\n" * 5)
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


def sanitise_for_analysis(text: str | Column) -> Column:
    """Control characters out, NFC, at most 50,000 characters. Spark has no normal forms, so those are an Arrow-batched function."""

    @F.pandas_udf("string")
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.normalize("NFC")

    return F.substring(nfc(swap(text, _CONTROL, "")), 1, MAX_ANALYSIS)


def sanitise_file_name(name: str | Column) -> Column:
    out = swap(name, r"[^\w\s\-.]", "")
    return F.substring(swap(swap(out, r"\.{2,}", "."), r"^\.+", ""), 1, 255)


def is_binary(content: str | Column) -> Column:
    """More than a tenth of the first 8 KB are NUL bytes. Empty content is not."""
    head = F.substring(F.col(content) if isinstance(content, str) else content, 1, 8192)
    nuls = F.size(F.filter(F.regexp_extract_all(F.hex(head), F.lit(".."), F.lit(0)), lambda b: b == "00"))
    return F.coalesce(nuls / F.nullif(F.octet_length(head), F.lit(0)) > 0.1, F.lit(False))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``redacted_text``, ``total_redactions`` and ``redactions`` (map of category to count, found ones only).

    One expression folds the steps, each over the text that the last one left, so
    the plan is a single projection over the scan.
    """
    steps = [("pre_redacted_placeholders", p, f, PLACEHOLDER) for p, f in PLACEHOLDERS]
    steps += list(PRIVATE)
    steps += [(n, p, f, f"$1{to}$2") for n, p, f, to in NAMED]
    done = F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.array().cast("array<bigint>").alias("n"))

    def after(name: str, pattern: str, flags: str, to: str):
        def step(a: Column) -> Column:
            hit = F.struct(swap(a["t"], pattern, to, flags).alias("t"), F.concat(a["n"], F.array(count(a["t"], pattern, flags))).alias("n"))
            if name not in GUARDS:
                return hit
            return F.when(a["t"].rlike(GUARDS[name]), hit).otherwise(F.struct(a["t"].alias("t"), F.concat(a["n"], F.array(F.lit(0).cast("bigint"))).alias("n")))

        return step

    for s in steps:
        done = let(done, after(*s))
    categories = list(dict.fromkeys(s[0] for s in steps))

    def summed(a: Column) -> Column:
        own = lambda c: sum((a["n"][i] for i, s in enumerate(steps) if s[0] == c), F.lit(0).cast("bigint"))
        counts = F.map_from_arrays(F.array(*[F.lit(c) for c in categories]), F.array(*[own(c) for c in categories]))
        return F.struct(a["t"].alias("t"), F.aggregate(a["n"], F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"), F.map_filter(counts, lambda _, v: v > 0).alias("by"))

    out = df.withColumn("__r", let(done, summed))
    return out.select(*df.columns, F.col("__r.t").alias("redacted_text"), F.col("__r.total").alias("total_redactions"), F.col("__r.by").alias("redactions"))


def scan_injection(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``injections``: (label, match) of the first hit of each pattern, at most 120 characters of it, in the order of the patterns."""
    hits = [
        F.when(F.col(text_col).rlike(java(p, f)), F.struct(F.lit(label).alias("label"), F.substring(F.regexp_extract(F.col(text_col), java(p, f), 0), 1, INJECTION_CHARS).alias("match")))
        for label, p, f in INJECTION
    ]
    return df.withColumn("injections", F.array_compact(F.array(*hits)))


def redact_injection(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every occurrence of the matches in ``injections``, longest first; add ``redacted_spans``."""
    matches = F.array_distinct(F.transform("injections", lambda i: i["match"]))
    ordered = F.array_sort(matches, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    start = F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.lit(0).cast("bigint").alias("n"))
    # The number of a literal's occurrences is what its removal shortens the text by, over its length.
    seen = lambda acc, m: ((F.length(acc["t"]) - F.length(F.replace(acc["t"], m, F.lit("")))) / F.length(m)).cast("bigint")
    done = F.aggregate(ordered, start, lambda acc, m: F.struct(F.replace(acc["t"], m, F.lit(INJECTION_MARK)).alias("t"), (acc["n"] + seen(acc, m)).alias("n")))
    return df.withColumn("__done", done).withColumn("neutral_text", F.col("__done.t")).withColumn("redacted_spans", F.col("__done.n")).drop("__done")


def pseudonym(day: Column, address: Column, agent: Column, key: str) -> Column:
    """Daily visitor name: HMAC-SHA-256 of day, address and agent under ``key``, by the definition of HMAC over built-in hashes."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    message = F.concat_ws("::", day.cast("string"), address, agent).cast("binary")
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def urls(text: str | Column) -> Column:
    return every(text, r"https?://[^\s<>)\]\"']+", "i")
