"""Quality by ordinal cumulative-link regression on graded ratings.

A text becomes hashed features: its words and a few bucketed statistics, all
with one shared weight vector. For grades 0 < 1 < ... the model has ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - weights . features). The
thresholds are kept in order by fitting the logarithms of their gaps. A row gets
its expected grade and the tail probability P(grade >= cut), by which rows are
selected.

Weights are fitted on at most ``sample`` graded rows chosen by a hash of the
id, none of them in the fold held out (crc32 of the id modulo 3 is 1).

Defined results: a null or empty text has the features of an empty text; a
model without graded rows has zero weights and keeps everything; a grade that
does not occur gets an empty interval; repeated rows get equal scores; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, table

SAMPLE = 9_000
DIMENSIONS = 1 << 16
#: Lowest grade that counts as good, and the tail probability from which a row is kept.
CUT, KEEP = 1, 0.5

_WORD = re.compile(r"[^\W_]+")
_UPPER = regex.compile(r"\p{Lu}")


class Features:
    """Hashed indexes and values of a text."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.n, self.memo = dimensions, {}

    def index(self, name: str) -> int:
        at = self.memo.get(name)
        if at is None:
            if len(self.memo) > 400_000:
                self.memo.clear()
            at = self.memo[name] = zlib.crc32(name.encode()) % self.n
        return at

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = _WORD.findall(text.lower())
        kinds = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        chars = max(1, len(text))
        letters = sum(map(len, words))
        upper = len(_UPPER.findall(text))
        stats = {
            "words": int(math.log2(len(words) + 1)),
            "distinct": int(20 * len(kinds) / max(1, len(words))),
            "top": int(20 * max(kinds.values(), default=0) / max(1, len(words))),
            "lines": int(20 * len(set(lines)) / max(1, len(lines))),
            "letters": int(20 * letters / chars),
            "upper": int(20 * upper / max(1, letters)),
            "digits": int(20 * sum(map(text.count, "0123456789")) / chars),
            "marks": int(20 * sum(map(text.count, "!#$%&*@^~|<>{}[]=+\\/_")) / chars),
            "stops": int(40 * sum(map(text.count, ".?!")) / max(1, len(words))),
            "size": int(letters / max(1, len(words))),
            "repeat": int(20 * sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))),
        }
        at = [self.index("w:" + w) for w in kinds] + [self.index(f"s:{k}={v}") for k, v in stats.items()]
        value = np.full(len(at), 1 / math.sqrt(max(1, len(kinds))), dtype=np.float32)
        value[len(kinds):] = 1.0
        return np.array(at, dtype=np.int32), value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(at: list[np.ndarray], value: list[np.ndarray], grade: np.ndarray, grades: int, dimensions: int = DIMENSIONS,
                steps: int = 120, rate: float = 0.15, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the whole sample."""
    w, theta = np.zeros(dimensions), np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)
    if not len(grade):
        return w, np.full(grades - 1, -30.0)
    free = np.concatenate([theta[:1], np.log(np.diff(theta))]) if grades > 1 else theta
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col, val = np.concatenate(at), np.concatenate(value).astype(float)
    moments = [np.zeros(dimensions), np.zeros(dimensions), np.zeros(len(free)), np.zeros(len(free))]
    n = len(grade)
    for t in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        edge = np.concatenate([[-1e3], theta, [1e3]])
        s = np.bincount(row, w[col] * val, n)
        hi, lo = _sigmoid(edge[grade + 1] - s), _sigmoid(edge[grade] - s)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = np.bincount(col, ((d_hi - d_lo) / n)[row] * val, dimensions) + ridge * w
        g_edge = -(np.bincount(grade + 1, d_hi, grades + 1) - np.bincount(grade, d_lo, grades + 1))[1:-1] / n
        g_free = np.concatenate([[g_edge.sum()], np.exp(free[1:]) * np.cumsum(g_edge[::-1])[::-1][1:]])
        for x, g, m, v in ((w, g_w, moments[0], moments[1]), (free, g_free, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Model from ``ratings`` (id, grade 0 .. grades - 1)."""
    chosen = (
        ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull() & (crc_fold(F.col(id_col)) != 1))
        .groupBy(F.col(id_col).alias("__id")).agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    )
    # The broadcast holds ``sample`` rows of two numbers.
    rows = table(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id").select("grade", "text").distinct(), "quality-sample")

    def run(batches):
        f = Features()
        for b in batches:
            got = [f(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["grade", "at", "value"])

    got = rows.mapInArrow(run, "grade int, at binary, value binary").collect()  # bounded by the sample
    got.sort(key=lambda r: (r["grade"], bytes(r["at"])))
    w, theta = fit_ordinal([np.frombuffer(bytes(r["at"]), np.int32) for r in got], [np.frombuffer(bytes(r["value"]), np.float32) for r in got],
                           np.array([r["grade"] for r in got], dtype=int), grades)
    return {"weights": w.astype(np.float32), "thresholds": theta}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, keep: float = KEEP) -> DataFrame:
    """Per row: id, ``expected_grade``, ``tail_probability`` and ``kept``."""
    w, theta = model["weights"], np.asarray(model["thresholds"])

    def run(batches):
        f = Features()
        for b in batches:
            s = np.array([float(w[a] @ v) for a, v in map(f, b.column(1).to_pylist())])
            above = 1 - _sigmoid(theta[None, :] - s[:, None])  # P(grade > k)
            tail = above[:, cut - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= keep)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
