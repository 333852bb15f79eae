"""Substring dedup by recompression.

A text is a sequence of symbols, at first its words. A round of recompression
names each maximal run of one symbol, then each pair of neighbours of which the
first is in one half of the alphabet and the second in the other. Name and half
come from a hash of what is named, so all tasks of all rounds name alike without
asking each other, and equal words get equal symbols but for a few at their
borders. Every symbol carries its context: the words that made it come out so.
Wherever those words stand, the symbol stands.

A window of :data:`WINDOW` words is known by three neighbouring symbols whose
contexts lie inside it, and so are all its copies (:func:`known_by`). Symbols
that know windows of one document only are left at that. Windows of the others
are named
whole (128 bits), and in each name's rows, sorted by document, those after the
smallest document are repeats. A task asks once for what its own batch holds
many times, so a passage of very many documents is a row a batch. Documents with
equal words are one document throughout.

Defined results: a null or blank text has no words and loses none; a null id
ranks with the largest long; rows that share an id are not earlier than each
other; of equal texts all but those with the smallest id lose all words, if they
are :data:`WINDOW` or more; an empty table gives an empty result; further columns
of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, lookup, table

#: Consecutive words that make a repeat.
WINDOW = 13
#: Neighbouring symbols that a window is known by.
TOGETHER = 3
#: Words that a task names together.
BLOCK = 1_000_000
#: Different words that a task remembers the hashes of.
MEMO = 500_000

_LAST = (1 << 63) - 1
_rng = np.random.default_rng(20240517)
_ODD = _rng.integers(0, 1 << 63, size=40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def recompress(symbols: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of a sequence, lowest first: symbols and where their contexts start and end (exclusive); a context may reach past the sequence by one."""
    s, x, y = symbols, np.arange(len(symbols)), np.arange(1, len(symbols) + 1)
    yield s, x, y
    for r in range(rounds):
        if not len(s):
            return
        # Runs. That a run ends where it does takes the symbols on both sides.
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        length = np.diff(np.append(first, len(s)))
        x_out, y_out = np.concatenate(([x[0] - 1], x)), np.append(y, y[-1] + 1)
        x, y = x_out[first], y_out[first + length]
        s = np.where(length > 1, _mix(s[first] * _ODD[2] + length.astype(np.uint64) * _ODD[3 + r]), s[first])
        # Pairs. A symbol of the left half looks to the right, one of the right half to the left.
        left = _mix(s + _ODD[10 + r]) & np.uint64(1) == 0
        opens = np.append(left[:-1] & ~left[1:], False)
        x_out, y_out = np.concatenate(([x[0] - 1], x[:-1])), np.append(y[1:], y[-1] + 1)
        pair = np.append(s[1:], s[:1])
        kept = ~np.concatenate(([False], opens[:-1]))
        named = np.where(opens, _mix(s * _ODD[20 + r] + _mix(pair) * _ODD[30]), s)
        x, y, s = np.where(left, x, x_out)[kept], np.where(left, y_out, y)[kept], named[kept]
        yield s, x, y


def known_by(symbols: np.ndarray, window: int = WINDOW, rounds: int | None = None) -> np.ndarray:
    """For every start of a window of ``symbols`` the symbols that it is known by: equal for equal windows, wherever they stand.

    Of the symbols whose contexts lie inside the window it is the :data:`TOGETHER` neighbours with the least hash, of the highest
    level that has as many; neighbouring windows mostly share them.
    """
    starts = np.arange(len(symbols) - window + 1)
    out = np.zeros(len(starts), np.uint64)
    for level, (s, x, y) in enumerate(recompress(symbols, rounds_for(window) if rounds is None else rounds)):
        together = TOGETHER if level else 1
        if len(s) < together:
            break
        size = len(s) - together + 1
        h = s[:size]
        for k in range(1, together):
            h = _mix(h * _ODD[34] + s[k : size + k])
        h = _mix(h + np.uint64(level))
        first = np.searchsorted(x, starts)
        n = np.searchsorted(y, starts + window, "right") - first - together + 1
        first, n, inside = first[n > 0], n[n > 0], n > 0
        least = h[first]
        for k in range(1, n.max(initial=1)):
            least = np.where(n > k, np.minimum(least, h[np.minimum(first + k, size - 1)]), least)
        out[inside] = least
    return out


def rounds_for(window: int) -> int:
    """Rounds whose symbols have contexts inside a window: one for 13 words, one more each time it doubles."""
    return max(1, (window // 13).bit_length())


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []  # of bytes: at ASCII white space


def _digest(words: list[bytes]) -> tuple[int, int, str]:
    d = hashlib.sha256(b" ".join(words))
    return int.from_bytes(d.digest()[:8], "little", signed=True), int.from_bytes(d.digest()[8:16], "little", signed=True), d.hexdigest()


class Block:
    """Documents whose windows are named together: word hashes with a separator between documents."""

    def __init__(self, docs: list[tuple], parts: list[np.ndarray], window: int):
        self.docs, self.window = docs, window
        gap = np.array([_ODD[31]])
        self.symbols = np.concatenate([p for part in parts for p in (part, gap)]) if parts else np.empty(0, np.uint64)
        n = np.array([len(p) for p in parts], np.int64)
        begin = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
        count = np.maximum(n - window + 1, 0)
        self.of = np.repeat(np.arange(len(n)), count)
        self.pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.start = begin[self.of] + self.pos
        self.doc = np.array([d[0] for d in docs], np.int64)[self.of] if docs else np.empty(0, np.int64)

    def keys(self) -> np.ndarray:
        return known_by(self.symbols, self.window)[self.start] if len(self.start) else np.empty(0, np.uint64)

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows at the indexes ``at``."""
        begin = self.start[at]
        h, g = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(self.window):
            w = self.symbols[begin + k]
            h = (h ^ w) * _ODD[32] + (h >> np.uint64(31))
            g = (g + w) * _ODD[33] ^ (g >> np.uint64(33))
        return _mix(h), _mix(g)


def _blocks(batches, repeated: Bits, window: int, block: int = BLOCK) -> Iterator[Block]:
    """Blocks of the documents (doc, text, settled): those that may have copies are left to the settled rows."""
    import xxhash

    memo: dict[bytes, int] = {}
    docs, parts, size = [], [], 0
    for batch in batches:
        for doc, text, settled in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = _words(text.as_py())
            if len(words) < window:
                continue
            p, q, _ = _digest(words)
            if not settled and p in repeated:
                continue
            try:
                part = np.array([memo[w] for w in words], np.uint64)
            except KeyError:
                if len(memo) > MEMO:
                    memo.clear()
                for w in words:
                    if w not in memo:
                        memo[w] = xxhash.xxh3_64_intdigest(w)
                part = np.array([memo[w] for w in words], np.uint64)
            docs.append((doc, p, q))
            parts.append(part)
            size += len(words)
            if size >= block:
                yield Block(docs, parts, window)
                docs, parts, size = [], [], 0
    if docs:
        yield Block(docs, parts, window)


def _rows(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _key_rows(corpus: DataFrame, repeated: Bits, window: int) -> DataFrame:
    """Rows (h, doc): what windows are known by, with the smallest and the largest document of a block that has it."""

    def run(batches):
        for b in _blocks(batches, repeated, window):
            key = b.keys()
            order = np.lexsort((b.doc, key))
            key, doc = key[order], b.doc[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(first[1:], len(key)) - 1
            wide = doc[first] < doc[last]
            at = np.concatenate((first, last[wide]))
            yield _rows(["h", "doc"], key[at].view(np.int64), doc[at])

    return corpus.mapInArrow(run, "h long, doc long")


def _window_rows(corpus: DataFrame, repeated: Bits, shared: Bits, window: int) -> DataFrame:
    """Windows that may be repeats: rows to ask for (name h, g and n = 0), and runs of n windows that a smaller document of the block is known to have."""

    def run(batches):
        cols = ["h", "g", "doc", "p", "q", "pos", "n"]
        for b in _blocks(batches, repeated, window):
            at = np.flatnonzero(shared.hit(b.keys()))
            if not len(at):
                continue
            h, g = b.names(at)
            order = np.lexsort((b.doc[at], g, h))
            at, h, g = at[order], h[order], g[order]
            doc = b.doc[at]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            p, q = (np.array([d[k] for d in b.docs], np.int64) for k in (1, 2))
            ask = doc == least
            of = b.of[at[ask]]
            yield _rows(cols, h[ask].view(np.int64), g[ask].view(np.int64), doc[ask], p[of], q[of], b.pos[at[ask]].astype(np.int32), np.zeros(len(of), np.int32))
            known = np.sort(at[~ask])
            if len(known):
                begins = np.concatenate(([True], (np.diff(known) > 1) | (b.of[known[1:]] != b.of[known[:-1]])))
                first = known[begins]
                n = np.diff(np.append(np.flatnonzero(begins), len(known)))
                of = b.of[first]
                yield _rows(cols, p[of] ^ b.pos[first], q[of], b.doc[first], p[of], q[of], b.pos[first].astype(np.int32), n.astype(np.int32))

    return corpus.mapInArrow(run, "h long, g long, doc long, p long, q long, pos int, n int")


def _repeats(asked: DataFrame) -> DataFrame:
    """Of asked windows those that a smaller document has too, and the known ones: rows (p, q, pos, n)."""

    def run(batches):
        carry = None
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in ("h", "g", "doc", "p", "q", "pos", "n")}
            is_known = c["n"] > 0
            k = {name: v[is_known] for name, v in c.items()}
            a = {name: v[~is_known] for name, v in c.items()}
            if len(a["h"]):
                new = np.concatenate(([True], (a["h"][1:] != a["h"][:-1]) | (a["g"][1:] != a["g"][:-1])))
                least = a["doc"][np.flatnonzero(new)]
                if carry is not None and carry[:2] == (a["h"][0], a["g"][0]):
                    least[0] = carry[2]
                carry = (a["h"][-1], a["g"][-1], least[-1])
                again = a["doc"] > least[np.cumsum(new) - 1]
                a = {name: v[again] for name, v in a.items()}
            yield _rows(["p", "q", "pos", "n"], *(np.concatenate((k[name], a[name])) for name in ("p", "q", "pos")), np.concatenate((k["n"], a["n"] + np.int32(1))))

    return asked.repartition(F.col("h")).sortWithinPartitions("h", "g", "doc").mapInArrow(run, "p long, q long, pos int, n int")


def _copies(docs: DataFrame, repeated: Bits) -> DataFrame:
    """Documents whose words may be those of another: (doc, text, p, q)."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _words(text.as_py())
                p, q, _ = _digest(words)
                if p in repeated:
                    out.append((doc, b" ".join(words), p, q))
            if out:
                yield _rows(["doc", "text", "p", "q"], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))))

    return docs.mapInArrow(run, "doc long, text binary, p long, q long")


def _hit_texts(corpus: DataFrame, repeated: Bits, hits: Bits) -> DataFrame:
    """Documents that may have lost words: (text, p, q)."""

    def run(batches):
        for batch in batches:
            out = []
            for text, settled in zip(batch.column(1), batch.column(2).to_pylist()):
                words = _words(text.as_py())
                p, q, _ = _digest(words)
                if p in hits and (settled or p not in repeated):
                    out.append((b" ".join(words), p, q))
            if out:
                yield _rows(["text", "p", "q"], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64()))))

    return corpus.mapInArrow(run, "text binary, p long, q long")


def _cut(joined: DataFrame, window: int) -> DataFrame:
    """Rows (p, q, n_removed, kept_sha256, kept) of texts with the runs of windows that are repeats."""

    def run(batches):
        for batch in batches:
            out = []
            for text, spans, p, q in zip(*(batch.column(k).to_pylist() for k in ("text", "spans", "p", "q"))):
                words = _words(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["pos"] for s in spans], 1)
                np.add.at(edge, [s["pos"] + s["n"] + window - 1 for s in spans], -1)
                stays = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, s in zip(words, stays) if s])
                out.append((p, q, int((~stays).sum()), hashlib.sha256(kept).hexdigest(), kept))
            if out:
                yield _rows(["p", "q", "n_removed", "kept_sha256", "kept"], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))))

    return joined.mapInArrow(run, "p long, q long, n_removed long, kept_sha256 string, kept binary")


def _sizes(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for doc, null, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
                words = _words(text.as_py())
                out.append((doc, null, len(words), *_digest(words)))
            if out:
                yield _rows(["doc", "no_id", "n_words", "p", "q", "sha"], *zip(*out))

    return docs.mapInArrow(run, "doc long, no_id boolean, n_words long, p long, q long, sha string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept_sha256 of the words that stay, joined by one space; with ``texts`` also those, as kept_text.

    A word goes if some window of consecutive words that covers it starts in a document with a smaller id too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).isNull().alias("no_id"))
    sized = table(_sizes(rows), "repeat-sizes")
    total = sized.count()
    groups = table(sized.groupBy("p", "q").agg(F.min("doc").alias("least"), F.count("*").alias("rows")), "repeat-groups")
    repeated = Bits(spark, groups.where("rows > 1").select(F.col("p").alias("h")))
    settled = table(_copies(rows, repeated).groupBy("p", "q").agg(F.min("doc").alias("doc"), F.any_value("text").alias("text")), "repeat-copies")
    corpus = rows.select("doc", "text", F.lit(False).alias("settled")).unionByName(settled.select("doc", "text", F.lit(True).alias("settled")))
    keys = _key_rows(corpus, repeated, window).groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    shared = Bits(spark, table(keys, "repeat-keys"))
    spans = _repeats(_window_rows(corpus, repeated, shared, window)).groupBy("p", "q").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    spans = table(spans, "repeat-spans")  # of one text, so no longer than it
    hits = Bits(spark, spans.select(F.col("p").alias("h")))
    cut = table(_cut(_hit_texts(corpus, repeated, hits).join(spans, ["p", "q"]), window).select("p", "q", "n_removed", "kept_sha256", *(["kept"] if texts else [])), "repeat-cut")
    info = groups.join(cut, ["p", "q"], "left")
    out = lookup(sized, info, ["p", "q"], "rows", total)
    copy = (F.col("doc") > F.col("least")) & (F.col("n_words") >= window)
    result = out.select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), "p", "q", *(["kept"] if texts else []))
    if not texts:
        return result.drop("p", "q")
    return _with_texts(result, rows, copy_is_empty=F.col("n_removed") == F.col("n_words"))


def _with_texts(result: DataFrame, rows: DataFrame, copy_is_empty) -> DataFrame:
    """``result`` with kept_text: what was cut, or the whole words of a text that lost none."""
    whole = _whole(rows)
    every = result.join(whole, ["p", "q"], "left")
    text = F.when(copy_is_empty, F.lit("")).when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("words").cast("string"))
    return every.select("doc_id", "n_words", "n_removed", "kept_sha256", text.alias("kept_text"))


def _whole(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = _words(text.as_py())
                p, q, _ = _digest(words)
                out.append((p, q, b" ".join(words)))
            if out:
                yield _rows(["p", "q", "words"], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))))

    return rows.mapInArrow(run, "p long, q long, words binary").groupBy("p", "q").agg(F.any_value("words").alias("words"))
