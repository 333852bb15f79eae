"""Phrase collocation mining over a minimal perfect hash.

Candidates come from Apriori sieves, one a length, words first: tasks count the
phrases of which all parts passed the sieve before, and those with fewer
occurrences than asked for can't be frequent. Tasks test parts against a bitmap
of bounded size, whose false hits only add candidates; the last count tests
against one of each length. Texts are split and their words numbered in arrays;
only a block's different words become Python objects. A phrase is named by its
words' 64-bit hashes; all words of the corpus are checked to have hashes of
their own (another seed is taken otherwise), so names are exact and texts are
needed for words only.

A minimal perfect hash gives every candidate of any length a slot, and its key
(the name) is stored there: a phrase that is not the key in its slot is not
counted. Up to :data:`HELD` candidates every task has the hash and bincounts a
numpy array, and arrays are summed up a tree. Beyond, the hash is built in shards
of bounded size, and what tasks have counted of a block is routed to the shards,
bincounted there and summed up a tree as well. Counts of both sides of every cut
are read by slot, of the array or of the shards.

A shard's rows are dealt over as many tasks as they need, so a phrase or word
with a third of all rows is spread, and tasks pre-aggregate a block of
:data:`BLOCK` words before any shuffle, and what is routed over blocks, as far as
:data:`ROWS` rows go.

Defined results: a null text is the empty one; a null lang is ``und`` and one
with the language of that name; repeated rows count each; an empty table gives
an empty result; ids and further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bits, lookup, table

#: Least occurrences of a candidate, most words, and phrases returned per language.
LEAST, LONGEST, TOP = 10, 3, 2000
#: A shorter phrase goes if a longer one around it has at least this share of its occurrences, in hundredths.
COVERED = 50
#: Words that a task counts together; fewer if the dictionaries of their parts have more entries than the second.
BLOCK, MEMO = 1_000_000, 300_000
#: Slots of a shard, rows that meet a shard in one task, arrays that meet in a node of the tree.
SLOTS, ROWS, FAN_IN = 1 << 17, 1 << 20, 16
#: Candidates that every task can hold: 24 bytes of name, 8 of count and a few bits each, so some 140 MB.
HELD = 1 << 22

_SPLIT = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_ODD = np.random.default_rng(20240611).integers(0, 1 << 63, size=6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hash:
    """Minimal perfect hash of different 64-bit hashes: a cascade of bit arrays, each with a place for those that collided in the one before."""

    ROOM = 1.6

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, bits
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))
        self.levels, at, rank = [], 0, 0
        for n in sizes:
            level = flat[at : at + n].astype(bool)
            before = (np.cumsum(level, dtype=np.int32) - level + rank).astype(np.int32)
            self.levels.append((level, before))
            at, rank = at + n, rank + int(level.sum())
        self.slots = rank

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (h ^ (h >> np.uint64(31))) * _ODD[0] + np.uint64(level * int(_ODD[1]) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(29))) * _ODD[2]
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray) -> Hash:
        sizes, flat = [], []
        while len(h):
            size = max(8, int(cls.ROOM * len(h)))
            at = cls._place(h, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flat.append(alone)
            h = h[~alone[at]]
        return cls(sizes, np.packbits(np.concatenate(flat)).tobytes() if flat else b"")

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Slots; of what is not a key any slot, or -1."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for k, (level, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(h[left], k, len(level))
            here = level[at]
            out[left[here]] = before[at[here]]
            left = left[~here]
        return out


#: Columns of a name: hashes of a phrase's words, 0 beyond its last one.
NAME = ("w1", "w2", "w3")
_NAME_TYPE = ", ".join(f"{c} long" for c in NAME)


def _slots_of(shard: dict, h: np.ndarray, name: list[np.ndarray]) -> np.ndarray:
    """Slots of names with hashes ``h`` in a shard, -1 for those that are not among its keys."""
    mph = shard.get("hash") or shard.setdefault("hash", Hash(shard["sizes"], shard["bits"]))  # built once a worker
    out = mph(h.view(np.uint64))
    same = out >= 0
    for own, asked in zip(shard["keys"], name):
        same &= own[out] == asked
    out[~same] = -1
    if len(shard["keys"][0]) > mph.slots:  # keys whose 64-bit hash is another's too
        twins = {k: i + mph.slots for i, k in enumerate(zip(*[c[mph.slots :].tolist() for c in shard["keys"]]))}
        for i in np.flatnonzero(~same):
            out[i] = twins.get(tuple(int(c[i]) for c in name), -1)
    return out


def _array(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().values.to_numpy()


def _shard(t: pa.Table) -> dict:
    return {"sizes": t.column("sizes")[0].as_py(), "bits": t.column("bits")[0].as_py(), "keys": [_array(t, c) for c in NAME]}


def _named(t: pa.Table) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in NAME]


def _lists(columns: dict) -> pa.Table:
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array([v], pa.list_(pa.int64())) for k, v in columns.items()})


def _key_hash(name: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(name[0]), np.uint64)
    for c in name:
        h = (h ^ (h >> np.uint64(31))) * _ODD[3] + c.view(np.uint64) * _ODD[4]
    return (h ^ (h >> np.uint64(32))) * _ODD[5]


def _by_slot(h: np.ndarray, name: list[np.ndarray]) -> dict:
    """Minimal perfect hash of different names with their hashes, and the names by slot."""
    first = np.zeros(len(h), bool)
    first[np.unique(h, return_index=True)[1]] = True
    mph = Hash.of(h[first])
    slot = np.empty(len(h), np.int64)
    slot[first] = mph(h[first])
    slot[~first] = mph.slots + np.arange((~first).sum())
    order = np.argsort(slot)
    return {"sizes": mph.sizes, "bits": mph.bits, "keys": [c[order] for c in name]}


class Held:
    """Counts of phrases in one array by the slots of a hash that every task has; at most HELD of them."""

    def __init__(self, keys: DataFrame, texts: DataFrame, seed: int, sieves: list[Bits]):
        self.spark = keys.sparkSession
        got = keys.toArrow()
        name = [np.ascontiguousarray(got.column(c).to_numpy()) for c in NAME]
        self.size = len(name[0])
        self.hash = self.spark.sparkContext.broadcast(_by_slot(_key_hash(name), name))
        self.counts = self.spark.sparkContext.broadcast(self._count(texts, seed, sieves))

    def _count(self, texts: DataFrame, seed: int, sieves: list[Bits]) -> np.ndarray:
        held, size, step = self.hash, self.size, SLOTS

        def run(batches):
            from pyspark import TaskContext

            counts = np.zeros(size, np.int64)
            for lexicon, ids in _blocks(batches, seed, BLOCK):
                for name, c in _block_names(lexicon, ids, sieves, 1, LONGEST):
                    slot = _slots_of(held.value, _key_hash(name), name)
                    counts += np.bincount(slot[slot >= 0], weights=c[slot >= 0], minlength=size).astype(np.int64)  # exact below 2**53
            for k, at in enumerate(range(0, size, step)):
                part = counts[at : at + step]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part], pa.list_(pa.int64()))], names=["shard", "salt", "counts"])

        arrays = texts.mapInArrow(run, "shard int, salt int, counts array<long>")
        out = np.zeros(size, np.int64)
        for r in _tree_sum(arrays, texts.rdd.getNumPartitions()).toArrow().to_pylist():
            at = r["shard"] * step
            out[at : at + len(r["counts"])] = r["counts"]
        return out

    def frequent(self, least: int) -> DataFrame:
        held, counts = self.hash, self.counts

        def run(batches):
            for batch in batches:
                at = batch.column(0).to_numpy()
                at = at[counts.value[at] >= least]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in held.value["keys"]], pa.array(counts.value[at])], names=[*NAME, "f"])

        return self.spark.range(self.size).mapInArrow(run, f"{_NAME_TYPE}, f long")

    def read(self, asked: DataFrame) -> DataFrame:
        """Rows of ``asked`` (a name and other columns) with the name's count ``f``."""
        held, counts = self.hash, self.counts

        def run(batches):
            for batch in batches:
                name = [batch.column(c).to_numpy() for c in NAME]
                slot = _slots_of(held.value, _key_hash(name), name)
                f = np.where(slot >= 0, counts.value[slot], 0) if len(slot) else slot
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], names=[*batch.schema.names, "f"])

        return asked.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in asked.dtypes) + ", f long")


class Counts:
    """Phrases with their counts by slot: shards (shard, sizes, bits, w1, w2, w3, counts)."""

    def __init__(self, shards: DataFrame, number: int):
        self.shards, self.number = shards, number

    def frequent(self, least: int) -> DataFrame:
        """Rows (w1, w2, w3, f)."""
        return self.shards.select(F.explode(F.arrays_zip(*NAME, "counts")).alias("e")).select(*[F.col("e")[c].alias(c) for c in NAME], F.col("e.counts").alias("f")).where(F.col("f") >= least)

    def read(self, asked: DataFrame) -> DataFrame:
        """Rows of ``asked`` (a name and other columns) with the name's count ``f``."""
        cols = asked.columns
        schema = ", ".join(f"{c} {t}" for c, t in asked.dtypes) + ", f long"

        def look(left, right):
            if not left.num_rows:
                return pa.table({c: left.column(c) for c in cols} | {"f": pa.array([], pa.int64())})
            slot = _slots_of(_shard(right), _key_hash(_named(left)), _named(left))
            return pa.table({c: left.column(c) for c in cols} | {"f": pa.array(np.where(slot >= 0, _array(right, "counts")[slot], 0))})

        left, right = _routed(asked, asked.count(), self.shards, self.number)
        return left.cogroup(right).applyInArrow(look, schema)


def _shard_of(number: int) -> F.Column:
    return F.pmod(F.xxhash64(*NAME), F.lit(number)).cast("int")


def _routed(rows: DataFrame, total: int, shards: DataFrame, number: int):
    """``rows`` and ``shards`` grouped to meet: a shard is copied for every ROWS rows that it is asked for."""
    salts = max(1, math.ceil(total / number / ROWS))
    own = rows.withColumn("shard", _shard_of(number)).withColumn("salt", F.pmod(F.spark_partition_id() + F.col("shard"), F.lit(salts)).cast("int"))
    copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return own.groupBy("shard", "salt"), copies.groupBy("shard", "salt")


def count_phrases(rows: DataFrame, keys: DataFrame, slots: int = SLOTS) -> Counts:
    """Sum local counts (a name, c) by the slots of a minimal perfect hash over ``keys``, different names, in shards."""
    rows = table(rows, "phrase-counts")
    total = rows.count()
    number = max(1, math.ceil(keys.count() / slots))

    def build(key, t):
        shard = _by_slot(_key_hash(_named(t)), _named(t))
        return _lists({"shard": pa.array([key[0].as_py()], pa.int32()), "sizes": shard["sizes"], "bits": pa.array([shard["bits"]])} | dict(zip(NAME, shard["keys"])))

    lists = ", ".join(f"{c} array<long>" for c in NAME)
    shards = table(keys.withColumn("shard", _shard_of(number)).groupBy("shard").applyInArrow(build, f"shard int, sizes array<long>, bits binary, {lists}"), "phrase-shards")

    def bincount(key, left, right):
        shard = _shard(right)
        counts = np.zeros(len(shard["keys"][0]), np.int64)
        if left.num_rows:
            slot, c = _slots_of(shard, _key_hash(_named(left)), _named(left)), left.column("c").to_numpy()
            counts += np.bincount(slot[slot >= 0], weights=c[slot >= 0], minlength=len(counts)).astype(np.int64)  # exact below 2**53
        return _lists({"shard": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "counts": counts})

    left, right = _routed(rows, total, shards, number)
    arrays = left.cogroup(right).applyInArrow(bincount, "shard int, salt int, counts array<long>")
    arrays = _tree_sum(arrays, max(1, math.ceil(total / number / ROWS)))
    return Counts(table(shards.join(arrays.drop("salt"), "shard"), "phrase-slots"), number)


def _tree_sum(arrays: DataFrame, salts: int) -> DataFrame:
    """Arrays (shard, salt, counts) summed until there is one a shard, FAN_IN at a time."""
    while salts > 1:
        arrays = arrays.withColumn("salt", F.floor(F.col("salt") / FAN_IN).cast("int")).groupBy("shard", "salt").applyInArrow(_sum, "shard int, salt int, counts array<long>")
        salts = math.ceil(salts / FAN_IN)
    return arrays


def _sum(key, t):
    counts = np.sum([a.values.to_numpy() for a in t.column("counts")], axis=0, dtype=np.int64)
    return _lists({"shard": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "counts": counts})


class Lexicon:
    """Numbers of the words of some texts, each with its key (language and spelling) and hash."""

    def __init__(self, seed: int):
        self.parts: dict[str, list[tuple[pa.DictionaryArray, np.ndarray]]] = {}
        self.keys: list[bytes] = []
        self.seed, self.hashed = seed, np.empty(0, np.uint64)
        self.size = self.met = 0  # numbers, and different words of each part

    def add(self, texts: list[bytes], lang: str) -> None:
        """Take a part: its words as a dictionary and indices, and the places of words that a piece or a text ends before."""
        joined = np.frombuffer(b"\n".join([*texts, b""]).lower().translate(_SPLIT), np.uint8)  # of bytes: A-Z only
        inside = (joined != 32) & (joined != 10)
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends in turn, as the last byte is in no word
        starts = edges[::2]
        offsets = np.append(0, np.cumsum(edges[1::2] - starts))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])]).dictionary_encode()
        ends = np.searchsorted(starts, np.flatnonzero(joined == 10))
        self.parts.setdefault(lang, []).append((words, ends))
        self.size, self.met = self.size + len(words) + len(ends), self.met + len(words.dictionary)

    def numbers(self) -> np.ndarray:
        """Numbers of all words in order, a language at a time, -1 between pieces and at a text's end."""
        out = [np.empty(0, np.int64)]
        for lang, parts in self.parts.items():
            met = pa.concat_arrays([words.dictionary for words, _ in parts]).dictionary_encode()
            own, head = len(self.keys) + met.indices.to_numpy().astype(np.int64), lang.encode() + b"\t"
            self.keys += [head + w for w in met.dictionary.to_numpy(zero_copy_only=False)]
            for words, ends in parts:
                out.append(np.insert(own[words.indices.to_numpy()], ends, -1))
                own = own[len(words.dictionary) :]
        self.parts = {}
        return np.concatenate(out)

    def hashes(self) -> np.ndarray:
        """A hash per word, never 0."""
        import xxhash

        new = np.array([xxhash.xxh3_64_intdigest(k, self.seed) for k in self.keys[len(self.hashed) :]], np.uint64)
        self.hashed = np.concatenate((self.hashed, np.maximum(new, np.uint64(1))))
        return self.hashed


def _parts(batches, most: int) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, some ``most`` bytes at a time."""
    part, size = {}, 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            text = text.as_py()
            if text:
                part.setdefault(lang, []).append(text)
                size += len(text)
            if size >= most:
                yield part
                part, size = {}, 0
    if part:
        yield part


def _blocks(batches, seed: int, block: int) -> Iterator[tuple[Lexicon, np.ndarray]]:
    lexicon = Lexicon(seed)
    for part in _parts(batches, block):
        for lang, texts in part.items():
            lexicon.add(texts, lang)
        if lexicon.size >= block or lexicon.met > MEMO:
            yield lexicon, lexicon.numbers()
            lexicon = Lexicon(seed)
    if lexicon.parts:
        yield lexicon, lexicon.numbers()


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and the last one's; :func:`_hash_of` is the same in Spark."""
    return ((h << np.uint64(31)) | (h >> np.uint64(33))) ^ w


def _hash_of(length: int) -> F.Column:
    h = F.col("w1")
    for c in NAME[1:length]:
        h = F.shiftleft(h, 31).bitwiseOR(F.shiftrightunsigned(h, 33)).bitwiseXOR(F.col(c))
    return h


def _phrases(words: np.ndarray, ids: np.ndarray, sieves: list[Bits], longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per length the places where phrases start that may be frequent, as far as the sieves know."""
    at = np.flatnonzero(ids >= 0)
    h = words[ids[at]]
    for length in range(1, longest + 1):
        if length > 1:
            # Both parts that are one word shorter passed: the one at each place, and the one at the next.
            starts = np.zeros(len(ids) + 1, bool)
            starts[at] = True
            both = starts[at + 1]
            at, h = at[both], h[both]
            h = _mix(h, words[ids[at + length - 1]])
        if length <= len(sieves) and len(at):
            passed = sieves[length - 1].hit(h)
            at, h = at[passed], h[passed]
        yield length, at


def _distinct(ids: np.ndarray, at: np.ndarray, length: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different phrases of a length that start at ``at``, as columns of word numbers, and how many there are of each."""
    if length == 1:
        c = np.bincount(ids[at], minlength=words)
        some = np.flatnonzero(c)
        return [some], c[some]
    if words**length >= 1 << 63:
        rows, c = np.unique(np.stack([ids[at + k] for k in range(length)], axis=1), axis=0, return_counts=True)
        return list(rows.T), c
    code = ids[at]
    for k in range(1, length):
        code = code * np.int64(words) + ids[at + k]
    code, c = np.unique(code, return_counts=True)
    out = []
    for _ in range(length):
        code, last = np.divmod(code, np.int64(words))
        out.append(last)
    return out[::-1], c


def _block_names(lexicon: Lexicon, ids: np.ndarray, sieves: list[Bits], shortest: int, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Names and numbers of a block's phrases that may be frequent, a length at a time."""
    words = lexicon.hashes()
    for length, at in _phrases(words, ids, sieves, longest):
        if len(at) and length >= shortest:
            parts, c = _distinct(ids, at, length, len(words))
            yield [words[parts[k]].view(np.int64) if k < length else np.zeros(len(c), np.int64) for k in range(len(NAME))], c


def _spelled(docs: DataFrame, seed: int, block: int = BLOCK) -> DataFrame:
    """Rows (w1, key, c): words, hash and spelling, with their occurrences in a block."""

    def run(batches):
        for lexicon, ids in _blocks(batches, seed, block):
            c = np.bincount(ids[ids >= 0], minlength=len(lexicon.keys)) if (ids >= 0).any() else np.zeros(len(lexicon.keys), np.int64)
            some = np.flatnonzero(c)
            keys = pa.array([lexicon.keys[i] for i in some], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(lexicon.hashes()[some].view(np.int64)), keys, pa.array(c[some], pa.int64())], names=["w1", "key", "c"])

    return docs.mapInArrow(run, "w1 long, key string, c long")


def _combined(counted: Iterator[tuple[list[np.ndarray], np.ndarray]], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Names and numbers with those of one name added up, as long as at most ``most`` and what comes next are held. Names with one hash may stay apart."""
    held, size = [], 0
    for name, c in counted:
        held.append([*name, c])
        size += len(c)
        if size > most:
            held = [_added(held)]
            size = len(held[0][-1])
            if size > most // 2:  # adding up no longer makes much room
                yield held[0][:-1], held[0][-1]
                held, size = [], 0
    if held:
        *name, c = _added(held)
        yield name, c


def _added(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*held)]
    order = np.argsort(_key_hash(columns[:-1]))
    *name, c = [column[order] for column in columns]
    first = np.ones(len(c), bool)
    if len(c):
        first[1:] = np.any([n[1:] != n[:-1] for n in name], axis=0)
    at = np.flatnonzero(first)
    return [*[n[at] for n in name], np.add.reduceat(c, at) if len(c) else c]


def _occurring(docs: DataFrame, seed: int, sieves: list[Bits], shortest: int, longest: int, block: int = BLOCK, most: int = 0) -> DataFrame:
    """Rows (a name, c): phrases of these lengths that may be frequent, with their occurrences in a block, or in several as far as ``most`` rows go."""

    def run(batches):
        counted = (named for lexicon, ids in _blocks(batches, seed, block) for named in _block_names(lexicon, ids, sieves, shortest, longest))
        for name, c in _combined(counted, most) if most else counted:
            yield pa.RecordBatch.from_arrays([*[pa.array(n) for n in name], pa.array(c, pa.int64())], names=[*NAME, "c"])

    return docs.mapInArrow(run, f"{_NAME_TYPE}, c long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """Each language's ``top`` phrases of two or three words: lang, rank, phrase, a, l, r, n, score.

    a, l and r are occurrences of the phrase and of both sides of the cut that scores lowest, n all words of the language,
    score floor(1000000 * a * a / (l * r)). A phrase inside a longer candidate with ``covered`` hundredths of its occurrences is left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("binary").alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    seed = 0
    while True:
        words = table(_spelled(texts, seed).groupBy("w1", "key").agg(F.sum("c").alias("c")), "phrase-words")
        if words.count() == words.select("w1").distinct().count():
            break
        seed += 1  # two words have one hash
    n = words.groupBy(_lang_of("key").alias("lang")).agg(F.sum("c").alias("n"))
    words = words.where(F.col("c") >= least).select("w1", "key")
    sieves = [Bits(spark, words.select(F.col("w1").alias("h")))]
    none = F.lit(0).cast("bigint")
    keys = words.select("w1", none.alias("w2"), none.alias("w3"))
    for length in range(2, LONGEST + 1):
        sums = _occurring(texts, seed, sieves, length, length).groupBy(*NAME).agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        level = table(sums.select(*NAME), "phrase-sieve")
        keys = keys.unionByName(level)
        sieves.append(Bits(spark, level.select(_hash_of(length).alias("h"))))
    if keys.count() <= HELD:
        counts = Held(keys, texts, seed, sieves)
    else:
        counts = count_phrases(_occurring(texts, seed, sieves, 1, LONGEST, most=ROWS), keys)
    found = table(counts.frequent(least).withColumn("length", sum(F.when(F.col(c) != 0, 1).otherwise(0) for c in NAME)), "phrase-frequent")
    asked = found.where("length > 1").withColumn("k", F.explode(F.expr("sequence(1, length - 1)")))
    held = F.filter(F.array(*NAME), lambda w: w != 0)
    left, right = F.slice(held, F.lit(1), F.col("k")), F.slice(held, F.col("k") + 1, F.lit(LONGEST))
    asked = asked.withColumn("e", F.explode(F.array(F.struct(F.lit("l").alias("side"), left.alias("part")), F.struct(F.lit("r").alias("side"), right.alias("part")))))
    whole = F.struct(*NAME).alias("whole")
    asked = asked.select(whole, F.col("f").alias("a"), "k", "e.side", *[F.coalesce(F.get("e.part", F.lit(i)), F.lit(0)).alias(c) for i, c in enumerate(NAME)])
    answers = table(counts.read(asked), "phrase-cuts")
    by_side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = answers.groupBy("whole", "a", "k").agg(by_side("l").alias("l"), by_side("r").alias("r"))
    # a is at most l and r, so the score is at most 1,000,000; the products have up to 37 digits for counts below 10**15.
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)")
    best = cuts.withColumn("score", score).groupBy("whole", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    part = F.struct(*NAME).alias("whole")
    longer = answers.where("w2 <> 0").groupBy(part).agg(F.max("a").alias("around"))
    out = best.join(longer, "whole", "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
    out = _with_spelling(out, words).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))  # tasks keep their own first ones before the shuffle
    out = out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return out.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _lang_of(key: str) -> F.Column:
    return F.expr(f"left({key}, length({key}) - length(substring_index({key}, '\t', -1)) - 1)")


def _with_spelling(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows with ``lang`` and ``phrase`` of the name in ``whole``. A word of very many phrases is looked up by broadcast."""
    rows = table(rows, "phrase-rows")
    places = rows.select("whole", F.posexplode(F.array(*[F.col("whole")[c] for c in NAME])).alias("at", "w1")).where("w1 <> 0")
    places = table(places, "phrase-places")
    wanted = places.groupBy("w1").agg(F.count("*").alias("rows")).join(words, "w1")
    spelled = lookup(places, wanted, ["w1"], "rows", places.count())
    parts = F.array_sort(F.collect_list(F.struct("at", F.substring_index("key", "\t", -1).alias("word"))))
    named = spelled.groupBy("whole").agg(F.array_join(F.transform(parts, lambda p: p["word"]), " ").alias("phrase"), F.any_value(_lang_of("key")).alias("lang"))
    return rows.join(named, "whole")
