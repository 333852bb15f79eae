"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences by themselves. All others go to groups of bounded size; each group is
packed by best fit, longest first. Bins that are nearly full are emitted, the
others become items of the next round, where the bins of ``FAN_IN`` groups meet
and are packed again, and so on up a tree. A bin holds at most ``capacity``
pieces, so it travels as one row with its pieces inside.

Of two bins over half full none fits in the other, and best fit leaves a group at
most one bin that is half full or less (it would have gone into another). So at a
node of the tree at most ``FAN_IN`` bins find a place in others, and of its bins
of one fill no more than ``FAN_IN`` for each level above can ever be filled. A group
sends on that many of each fill and emits the rest, which loses nothing: what a
node sees is bounded by the number of different fills, not by the size of the data.

Defined results: a null or empty text is a document of one token, the id 0;
repeated rows are packed separately; an empty table gives an empty result;
further columns are ignored. Every piece is in exactly one sequence.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_texts, giving_back, table

CAPACITY = 2048
#: Pieces packed by one group of the first round.
GROUP = 12_000
FAN_IN = 8
#: Free tokens up to which a bin counts as nearly full.
SLACK = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STRUCT = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"

# Texts of these characters (no special tokens, no odd white space, no letters
# whose lower case depends on their place) can be tokenised word by word.
_PLAIN = re.compile("[\t\n\r -;=-~¡-įĲ-ɏ‐-‧]*(?:<(?!\\|)[\t\n\r -;=-~¡-įĲ-ɏ‐-‧]*)*")


#: The vocabulary's pre-tokens of plain, lower-case words, and what is between words.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[\d²³¹¼-¾]|(?:[^\w\s]|_)+|\n")

#: In place of an id between words.
_BETWEEN = 0xFFFFFFFF


class WordTokens:
    """Ids of whole texts as little-endian 32-bit numbers, with a bounded memo of pre-tokens.

    The vocabulary's pre-tokens never span white space and it lower-cases, so a
    plain text is the concatenation of its lower-case words' ids, and a word that
    of its pre-tokens'; other texts are encoded whole. The different words of a
    block are cut once, and of the different pre-tokens those that are not in the
    memo go through the vocabulary's merges.
    """

    #: Texts encoded together, and characters of them from which there are fewer.
    TEXTS, CHARS = 1024, 1 << 21

    def __init__(self, path: str, memo: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo, self.limit, self.held = Tokenizer.from_file(path), {}, memo, 0  # bytes held at most, and held
        self.merge = self.tokenizer.model.tokenize
        self.single = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        lower = {c for k in range(0x80, 0x2028) if _PLAIN.fullmatch(chr(k)) for c in chr(k).lower()}  # some of them beyond the range
        self.spelling = {ord(c): spelled(c)[0][0] for c in lower}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, parts: set[str]) -> None:
        for p in parts:
            ids = [self.single[t.id] for t in self.merge(p if p.isascii() else p.translate(self.spelling))]
            self.memo[p] = raw = ids[0] if len(ids) == 1 else b"".join(ids)
            self.held += len(p) + len(raw) + 160  # with what two objects and their place in a dict take

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = found.flatten().dictionary_encode()
        if not len(coded):
            return [np.empty(0, "<u4")] * len(texts)
        words = coded.dictionary
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        parts = _PARTS.findall(lines)
        if self.held > self.limit:
            self.memo, self.held = {}, 0
        self.memo["\n"] = _BETWEEN.to_bytes(4, "little")
        self._learn(set(parts) - self.memo.keys())
        ids = np.frombuffer(b"".join(map(self.memo.__getitem__, parts)), "<u4")
        stops = np.append(np.flatnonzero(ids == _BETWEEN), len(ids))
        starts = np.append(0, stops[:-1] + 1)
        of = coded.indices.to_numpy()
        size = (stops - starts)[of]
        ends = np.append(0, np.cumsum(size))
        at = np.repeat(starts[of] - ends[:-1], size)
        at += np.arange(len(at))
        return np.split(ids[at], ends[found.offsets.to_numpy()[1:-1]])

    def _blocks(self, texts: list[str]) -> Iterator[list[str]]:
        at = chars = 0
        for k, t in enumerate(texts):
            chars += len(t)
            if chars >= self.CHARS or k + 1 - at >= self.TEXTS:
                yield texts[at : k + 1]
                at, chars = k + 1, 0
        if at < len(texts):
            yield texts[at:]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for block in self._blocks(texts):
            plain = [_PLAIN.fullmatch(t) is not None and unicodedata.is_normalized("NFC", t) for t in block]
            some = [t.lower() for t, p in zip(block, plain) if p]
            made = iter(self._plain(some) if some else ())
            for text, p in zip(block, plain):
                yield next(made) if p else self._encode(text)


_HELD: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own, kept from task to task: later tasks find most words in its (bounded) memo."""
    if path not in _HELD:
        _HELD[path] = WordTokens(path)
    return _HELD[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Cut every document, with ``end_id`` after its ids, into pieces of at most ``capacity`` tokens."""

    def cut(batches):
        tokens = word_tokens(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out = ([], [], [], [], [])
            bodies = chain.from_iterable(tokens([t or "" for t in some]) for some in few_texts(batch.column(1), tokens.CHARS))
            for doc, body in zip(batch.column(0).to_pylist(), bodies):
                body = np.concatenate((body, end))
                n = len(body)
                for k, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    for col, v in zip(out, (doc, k, start, stop - start, zlib.crc32(body[start:stop]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())] + [pa.array(c, pa.int64()) for c in out[2:]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(cut), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indexes) by best fit, longest first. Open bins are kept by free space, with the spaces in use as bits of one integer."""
    free: dict[int, list[list[int]]] = {}
    spaces = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        above = spaces >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            held = free[room]
            bin_ = held.pop()
            if not held:
                spaces &= ~(1 << room)
        else:
            room, bin_ = capacity, []
        bin_.append(i)
        free.setdefault(room - n, []).append(bin_)
        spaces |= 1 << (room - n)
    return [b for held in free.values() for b in held]


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    Sequences are numbered by level of the tree, group and bin (63 bits), those of full pieces by row below zero. Pieces are
    dealt to groups by a hash that has the row's number in it, so rows that are all alike spread too.
    """
    items = table(items, "pack-pieces").withColumn("row", F.monotonically_increasing_id())
    full = items.where(F.col("length") >= capacity)
    part = items.where(F.col("length") < capacity)
    n = part.count()
    groups = max(1, math.ceil(n / group))
    levels = 0 if groups == 1 else math.ceil(math.log(groups, FAN_IN) - 1e-9)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = full.select(*columns, F.lit(0).cast("long").alias("offset"), (-1 - F.col("row")).alias("sequence_id"))
    todo = part.select(F.array(F.struct(*columns)).cast(_STRUCT).alias("pieces"), F.col("length").alias("filled"),
                       F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(groups)).cast("long").alias("grp"))
    done, level = [], 0
    while True:
        packed = table(_pack_groups(todo, capacity, level, 0 if groups == 1 else FAN_IN * max(1, levels - level)), "pack-level")
        done.append(packed.where("emit"))
        if groups == 1:
            break
        groups, level = math.ceil(groups / FAN_IN), level + 1
        todo = packed.where("not emit").select("pieces", "filled", F.floor(F.col("grp") / FAN_IN).cast("long").alias("grp"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    before = "aggregate(slice(pieces, 1, pos), 0L, (a, p) -> a + p.length)"
    laid = out.select("sequence_id", "pieces", F.posexplode("pieces").alias("pos", "p")).withColumn("offset", F.expr(before))
    return whole.unionByName(laid.select("p.*", "offset", "sequence_id"))


def _pack_groups(todo: DataFrame, capacity: int, level: int, of_a_fill: int) -> DataFrame:
    """Pack every group; of its underfull bins ``of_a_fill`` of each fill are not emitted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grp = int(pdf["grp"].iloc[0])
        held = [[tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in ps] for ps in pdf["pieces"]]
        order = sorted(range(len(held)), key=lambda i: [(p[0] is not None, p[0] or 0, *p[1:]) for p in held[i]])  # any order of rows gives the same bins
        lengths = pdf["filled"].to_numpy()[order]
        rows, sent = [], Counter()
        for i, b in enumerate(best_fit(lengths, capacity)):
            filled = int(lengths[b].sum())
            sent[filled] += 1
            emit = filled >= capacity - SLACK or sent[filled] > of_a_fill
            rows.append((level << 58 | grp << 24 | i, [p for k in b for p in held[order[k]]], filled, grp, emit))
        return pd.DataFrame(rows, columns=["sequence_id", "pieces", "filled", "grp", "emit"])

    return todo.groupBy("grp").applyInPandas(run, f"sequence_id long, pieces {_STRUCT}, filled long, grp long, emit boolean")
