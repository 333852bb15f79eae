"""Secret scans: fixed patterns plus a token-efficiency test.

The patterns (key assignments, access key ids, long hex runs) always report.
The method then looks at every other long run of key characters: a byte-pair
vocabulary covers words and names with few long tokens, random characters with
many short ones, so few characters per token expose a random string. Digests of
well-known lengths and identifiers (UUIDs, and words and short numbers joined by
``_ - / + =``) are left out first; a word of key length among them is tested by
itself, so a key of letters only is found too. Of a run that touches spans of the
fixed patterns the stretches outside of them are tested.

Defined results: a null or empty text has no spans; spans are code points, end
exclusive; repeated rows get equal results; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGN, MIN_RUN = 6, 20
#: Characters per token under which a run counts as random.
RATIO = 1.85

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_JOINT = re.compile(r"[_/=+-]+")
_WORD = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,8}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) of the fixed patterns."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class TokenTest:
    """Characters per token of a run, under a byte-pair vocabulary in rank format."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def sparse(self, run: str) -> bool:
        """Few characters per token."""
        return len(run) < RATIO * len(self.encoding.encode_ordinary(run))

    def random(self, run: str) -> bool:
        if _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
            return False
        parts = _JOINT.split(run)
        if all(map(_WORD.fullmatch, parts)):
            return any(len(p) >= MIN_RUN and self.sparse(p) for p in parts)
        return self.sparse(run)


def _outside(start: int, end: int, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Stretches of a run that no base span touches; ``base`` is sorted by start."""
    for s, _, e in base:
        if e > start and s < end:
            if s > start:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def spans(text: str, test: TokenTest) -> list[tuple[int, int, str]]:
    """All spans by start, then kind: the base ones and what the test finds outside them."""
    base = base_spans(text)
    out, at = list(base), 0
    ends = list(accumulate((e for _, _, e in base), max))  # in order, so spans before a run are passed over once
    for m in RUN.finditer(text):
        while at < len(base) and ends[at] <= m.start():
            at += 1
        stop = bisect_left(base, (m.end(),))
        for s, e in _outside(m.start(), m.end(), base[at:stop]):
            if e - s >= MIN_RUN and test.random(text[s:e]):
                out.append((s, 3, e))
    return sorted(out)


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts by base kind, digest of the base spans, all spans."""

    def run(batches):
        test = TokenTest(ranks_path, pattern)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                found = spans(text or "", test)
                base = [x for x in found if x[1] < 3]
                n = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``."""

    def one(text, test):
        if text is None:
            return None
        out, at = [], 0
        for s, _, e in spans(text, test):
            if e > at:
                out += [text[at:max(at, s)], mark]
                at = e
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        test = TokenTest(ranks_path, pattern)
        for texts in batches:
            yield pd.Series([one(t, test) for t in texts], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
