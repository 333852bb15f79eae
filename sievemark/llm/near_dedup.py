"""Near-dedup by a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct 5-word shingles. Its signature is 48 MinHash
values of which the low 16 bits stay, in 8 chunks of 6. Two signatures that
differ in at most ``2 * 8 - 1 = 15`` symbols have, by pigeonhole, a chunk with at
most one error. The errors allowed are enumerated: every chunk yields a key for
each of its symbols with that symbol left out, so two documents share a key
exactly if some chunk has at most one error. All pairs up to distance 15 meet
for sure; beyond it, of pairs with similarity 0.85 about 6 in a million don't.

A shared key makes a candidate. Links are confirmed on full sets, in rounds that
avoid writing all pairs of a large group:

1. The members of every key are dealt into blocks of bounded size, each key its
   own way. In every block the spanning tree over estimated distances is
   confirmed and the components of confirmed links are found. A large cluster
   shares many keys, so its blocks grow together.
2. Of every key that holds several components the node with most links of each
   meets the others' and so, again, spanning trees are confirmed: a text of which
   all others are variants gathers those that it had not met.
3. Only where a key still holds several components, the pairs between them are
   confirmed within the task that holds the key (sketches meet there first, then
   the full sets of rows that are in a pair left over), nearest first, until the
   components are one or no pair is left: rows go out for links only, no more than
   the key has members. Members of keys larger than a block (documents that share
   a passage, say) are keyed anew by the rarest shingles of their sets: two sets
   with a link share one of those by the prefix principle, so pairs that share
   only what is common do not meet. Pairs within a component would change nothing.

So two documents of one component are connected. Of candidate pairs between
components only those whose estimates are 6 deviations off stay unchecked: of
pairs with similarity 0.85 about 5 in 100 million, which with those that don't
meet makes 6 in a million missed. A group of rare shingles that is still larger
than a block and holds several components (sets that differ from each other in
little more than the limit) is compared block by block, each pair of blocks a
task's group; that part alone is quadratic in such a group.

Copies (equal sets) are one node throughout. Defined results: a null, empty or
blank text has an empty set, is linked with nothing and keeps its own id; rows
with a null id take part, and a component's id is its smallest id that is not
null; repeated rows are copies with the same id; an empty table gives an empty
result; further columns of any name are ignored, or kept by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import bitmap, bitmap_bits, drop, few_texts, giving_back, lookup, mark, table, unwrap, wrap
from .graph import components

WORDS = 5
#: A link: 100 * size of the intersection >= SIMILARITY * size of the union.
SIMILARITY = 85
CHUNKS, CHUNK = 8, 6
SYMBOLS = CHUNKS * CHUNK
#: 8-bit symbols of the estimates in round 1 and 2.
COARSE, FINE = 128, 512
#: Standard deviations that an estimate of a link may be off.
MARGIN = 6.0
#: Members of a key that form a block.
BLOCK = 400
#: Counters of shingle frequencies (their order only has to be the same for all sets).
COUNTERS = 1 << 18

_rng = np.random.default_rng(20240131)
_ODD = _rng.integers(0, 1 << 63, size=SYMBOLS + FINE + WORDS + SYMBOLS + 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INDEX, _SKETCH = _ODD[:SYMBOLS], _ODD[SYMBOLS : SYMBOLS + FINE]
_PLACE, _PART, _MIX = _ODD[SYMBOLS + FINE :][:WORDS], _ODD[SYMBOLS + FINE + WORDS :][:SYMBOLS], _ODD[-1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Shingles:
    """Sorted 64-bit hashes of the distinct shingles of a text."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        try:
            w = np.array([memo[x] for x in words], dtype=np.uint64)
        except KeyError:
            for x in words:
                if x not in memo:
                    memo[x] = xxhash.xxh3_64_intdigest(x)
            w = np.array([memo[x] for x in words], dtype=np.uint64)
        n = len(w)
        if n < WORDS:
            return _mix((w * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        s = w[: n - WORDS + 1] * _PLACE[0]
        for k in range(1, WORDS):
            s = s + w[k : n - WORDS + 1 + k] * _PLACE[k]
        return np.unique(_mix(s + np.uint64(WORDS)))


def minima(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """MinHash values of a set under the permutations x -> x * odd."""
    out = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // len(odd))
    for at in range(0, len(shingles), step):
        np.minimum(out, (shingles[None, at : at + step] * odd[:, None]).min(axis=1), out=out)
    return out


def keys(symbols: np.ndarray) -> np.ndarray:
    """Index keys of signatures (rows of 48 symbols): of each chunk, one for each symbol left out."""
    parts = (symbols.astype(np.uint64) + np.uint64(1)) * _PART[None, :]
    parts = parts.reshape(-1, CHUNKS, CHUNK)
    without = parts.sum(axis=2, keepdims=True, dtype=np.uint64) - parts
    place = (np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(1, CHUNKS, CHUNK)
    return _mix(_mix(without) + place).reshape(-1, SYMBOLS).view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, fp, sig): size of the set, 128-bit digest of it (null if empty), signature."""

    def run(batches):
        shingles = Shingles()
        for b in batches:
            n, fp, sig = [], [], []
            for text in chain.from_iterable(few_texts(b.column(1))):
                s = shingles(text)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minima(s, _INDEX).astype("<u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run), "doc_id long, n long, fp binary, sig binary")


@F.pandas_udf(BinaryType())
def _digest(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Digests of the texts' sets as :func:`sign` has them."""
    shingles = Shingles()
    for batch in texts:
        sets = (shingles(t) for t in batch)
        yield pd.Series([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], dtype=object)
    pa.default_memory_pool().release_unused()


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                k = keys(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, SYMBOLS), pa.int32()), pa.array(k.ravel()))], ["node", "keys"])

    return nodes.select("node", "sig").mapInArrow(giving_back(run), "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _sets(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame) -> DataFrame:
    """Rows (node, n, items, sketch) of the nodes in ``reps`` (node, fp, rep): full set and estimate symbols.

    A bitmap of their ids picks their texts in a scan; only those are shuffled.
    """
    bits = bitmap_bits(reps.count())
    ids = bitmap(reps.select(F.xxhash64("rep").alias("h")), bits)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = mark(rows, F.xxhash64("doc_id"), ids, bits, "hit").where("hit").select("doc_id", "text")
    wanted = picked.join(reps.groupBy("rep").agg(F.lit(1).alias("one")), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def run(batches):
        shingles = Shingles()
        for b in batches:
            fp, n, items, sketch = [], [], [], []
            for text in chain.from_iterable(few_texts(b.column(0))):
                s = shingles(text)
                if len(s):
                    fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    n.append(len(s))
                    items.append(s.tobytes())
                    sketch.append(minima(s, _SKETCH).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(items, pa.binary()), pa.array(sketch, pa.binary())], ["fp", "n", "items", "sketch"])

    made = wanted.select("text").mapInArrow(giving_back(run), "fp binary, n long, items binary, sketch binary")
    return table(made.join(reps.select("fp", "node"), "fp").dropDuplicates(["node"]).drop("fp"), "near-sets")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links on their full sets."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("items").alias(f"items_{k}"))
    sized = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sets.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    sized = sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY).select("a", "b")
    full = sized.join(side("a"), "a").join(side("b"), "b").select("a", "b", "items_a", "items_b")

    def run(batches):
        for b in batches:
            m = pa.array([_linked(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], ["a", "b"])

    return table(full.mapInArrow(giving_back(run), "a long, b long"), "near-links")


def _most(symbols: int) -> int:
    """Symbols in which the estimates of a link may differ."""
    q = 1 - SIMILARITY / 100
    return int(symbols * q + MARGIN * (symbols * q * (1 - q)) ** 0.5)


def _dealt(members: DataFrame, columns: list[str]) -> DataFrame:
    """Deal the members of every key into blocks, each key its own way; sorted by cell."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cell = F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), blocks))
    return members.select(cell.alias("cell"), "node", *columns).repartition("cell").sortWithinPartitions("cell", "node")


def _cells(members: DataFrame, columns: list[str]) -> DataFrame:
    """Deal the members of every key into blocks, and rows to each pair of blocks; sorted by cell."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("cell"), (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("same"), "node", *columns)
    return rows.repartition("cell").sortWithinPartitions("cell", "node")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | list]]:
    """Columns of one cell at a time, from batches sorted by cell (first column)."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        cell = t.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(cell)) + 1
        if not len(cuts):
            held = t
            continue
        done = t.slice(0, int(cuts[-1])).combine_chunks()
        held = t.slice(int(cuts[-1]))
        yield from _split(done, np.concatenate([[0], cuts]))
    if held is not None and held.num_rows:
        yield from _split(held.combine_chunks(), np.array([0, held.num_rows]))


def _split(t: pa.Table, cuts: np.ndarray) -> Iterator[list]:
    columns = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in t.columns]
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield [c[x:y] for c in columns]


def _distances(x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(x)), np.int32)
    step = max(1, (1 << 23) // max(1, x.size))
    for at in range(0, len(x), step):
        out[at : at + step] = (x[at : at + step, None, :] != x[None, :, :]).sum(axis=2)
    return out


def _trees(cells: DataFrame) -> DataFrame:
    """Distinct edges (a, b) of the spanning trees of all cells (cell, node, sketch), over estimated distances."""
    most = _most(COARSE)

    def run(batches):
        a, b = [], []
        for _, node, sketch in _by_cell(batches):
            n = len(node)
            d = _distances(np.frombuffer(b"".join(sketch), np.uint8).reshape(n, COARSE))
            near, by = d[0].copy(), np.zeros(n, np.int64)
            near[0] = 1 << 20
            for _ in range(n - 1):
                k = int(near.argmin())
                if near[k] <= most:
                    a.append(int(min(node[k], node[by[k]])))
                    b.append(int(max(node[k], node[by[k]])))
                closer = (d[k] < near) & (near < 1 << 20)
                near[closer], by[closer] = d[k][closer], k
                near[k] = 1 << 20
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.mapInArrow(giving_back(run), "a long, b long").where("a <> b").distinct()


def _coarse(sets: DataFrame) -> DataFrame:
    return sets.select("node", F.substring("sketch", 1, COARSE).alias("sketch"))


def _hubs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Of each (key, component) the node with most links, dealt into blocks by key; that of a key's largest component is in each of its blocks."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    held = members.join(ends, "node", "left").groupBy("key", "component").agg(
        F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("node")).alias("least"))).alias("top"), F.count("*").alias("rows")
    ).select("key", (-F.col("top.least")).alias("node"), "rows")
    keys_ = held.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("rows", "node")).alias("largest"))
    dealt = held.join(keys_.select("key", "size"), "key").select("key", "size", "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = dealt.select("key", F.pmod(F.xxhash64("node", "key"), blocks).cast("int").alias("block"), "node")
    first = keys_.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("largest.node").alias("node"))
    return own.unionByName(first).distinct().select(F.xxhash64("key", "block").alias("cell"), "node")


def _pairs(node, second, same, key, component, sig, sketch, size, shared_keys: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell's rows, nearest first, that are of different components and may be links as far as sketches and sizes tell.

    With ``shared_keys`` (of the index) a pair is looked at under its first shared key only.
    """
    coarse, fine, n = _most(COARSE), _most(FINE), len(node)
    sk = np.frombuffer(b"".join(sketch), np.uint8).reshape(n, FINE)
    d = _distances(sk[:, :COARSE])
    ok = (d <= coarse) & (component[:, None] != component[None, :])
    if not same.all():  # a cell of two blocks: pairs within one are another cell's
        ok &= second[:, None] != second[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    if not len(i):
        return
    order = np.argsort(d[i, j], kind="stable")
    i, j = i[order], j[order]
    of = keys(np.frombuffer(b"".join(sig), "<u2").reshape(n, SYMBOLS)) if shared_keys else None
    for at in range(0, len(i), 20_000):
        x, y = i[at : at + 20_000], j[at : at + 20_000]
        m = ((sk[x] != sk[y]).sum(axis=1) <= fine) & (100 * np.minimum(size[x], size[y]) >= SIMILARITY * np.maximum(size[x], size[y]))
        x, y = x[m], y[m]
        if of is not None and len(x):
            m = of[x, (of[x] == of[y]).argmax(axis=1)] == key[0]
            x, y = x[m], y[m]
        yield x, y


def _paired(members: DataFrame, nodes: DataFrame, sets: DataFrame, shared_keys: bool) -> DataFrame:
    """Of the cells' rows those that are in one of its :func:`_pairs`. Only their sets have to meet: a pair shares many keys and is looked at under one."""
    rows = members.join(sets.select("node", "n", "sketch"), "node").join(nodes.select("node", "sig"), "node")
    cells = _cells(rows, ["key", "component", "n", "sig", "sketch"])

    def run(batches):
        for cell, second, same, node, key, component, n, sig, sketch in _by_cell(batches):
            held = np.zeros(len(node), bool)
            for x, y in _pairs(node, second, same, key, component, sig, sketch, n, shared_keys):
                held[x] = held[y] = True
            if held.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[held]) for c in (cell, second, same, node, key, component)], ["cell", "second", "same", "node", "key", "component"])

    return table(cells.mapInArrow(giving_back(run), "cell long, second boolean, same boolean, node long, key long, component long"), "near-paired")


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, shared_keys: bool) -> DataFrame:
    """Links (a, b) between different components of a key: as many as connect what can be, found nearest first on full sets."""
    rows = _paired(members, nodes, sets, shared_keys).join(sets.select("node", "n", "sketch", "items"), "node").join(nodes.select("node", "sig"), "node")
    rows = rows.select("cell", "second", "same", "node", "key", "component", "n", "sig", "sketch", "items")

    def run(batches):
        for _, second, same, node, key, component, n, sig, sketch, items in _by_cell(batches):
            joined = {int(c): int(c) for c in component}

            def root(x):
                while joined[x] != x:
                    joined[x] = joined[joined[x]]
                    x = joined[x]
                return x

            a, b = [], []
            for x, y in _pairs(node, second, same, key, component, sig, sketch, n, shared_keys):
                for p, q in zip(x.tolist(), y.tolist()):
                    r, t = root(int(component[p])), root(int(component[q]))
                    if r != t and _linked(items[p], items[q]):
                        joined[max(r, t)] = min(r, t)
                        a.append(int(min(node[p], node[q])))
                        b.append(int(max(node[p], node[q])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(giving_back(run), "a long, b long").distinct()


def _linked(x: bytes, y: bytes) -> bool:
    """Whether two sets are similar enough."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def _rare(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (key, node, component, size) of the groups of ``nodes`` (node, component) by each of the rarest shingles of
    their sets, as many as make two sets with a link share one; groups of one component are left out."""
    own = table(nodes.join(sets.select("node", "items"), "node"), "near-hot")

    def count(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                seen += np.bincount((np.frombuffer(x, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    # At most COUNTERS rows of two numbers (4 MB) reach the driver and go to the tasks, whatever the input.
    counted = own.select("items").mapInArrow(giving_back(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(COUNTERS, np.int64)
    seen[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    often = nodes.sparkSession.sparkContext.broadcast(seen)

    def prefix(batches):
        for b in batches:
            key, node, component = [], [], []
            for at, comp, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = np.frombuffer(x, np.uint64)
                n = len(x) + (-SIMILARITY * len(x) // 100) + 1
                first = x[np.lexsort((x, often.value[(x % np.uint64(COUNTERS)).astype(np.int64)]))[:n]].view(np.int64)
                key.append(first)
                node.append(np.full(len(first), at))
                component.append(np.full(len(first), comp))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (key, node, component)], ["key", "node", "component"])

    rows = table(own.select("node", "component", "items").mapInArrow(giving_back(prefix), "key long, node long, component long"), "near-rare")
    mixed = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    return table(rows.join(mixed.select("key", "size"), "key"), "near-rare-members")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and the distinct sets among them: fp, rep, class_size, component, n_links (null if none)."""
    signed = table(sign(docs, id_col, text_col), "near-signed")
    nodes = table(
        signed.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.min("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    keyed = _keyed(nodes)
    buckets = table(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("a"), F.max("node").alias("b")).where("size > 1"), "near-keys")
    twos = buckets.where("size = 2").select("a", "b").distinct()
    more = buckets.where("size > 2")
    bits = bitmap_bits(more.count())
    hits = mark(keyed, F.xxhash64("key"), bitmap(more.select(F.xxhash64("key").alias("h")), bits), bits, "hit").where("hit").drop("hit")
    members = table(hits.join(more.select("key", "size"), "key"), "near-members")
    wanted = members.select("node").unionByName(twos.select(F.col("a").alias("node"))).unionByName(twos.select(F.col("b").alias("node"))).distinct()
    sets = _sets(docs, id_col, text_col, table(nodes.select("node", "fp", "rep").join(wanted, "node"), "near-wanted"))

    tried = table(twos.unionByName(_trees(_dealt(members.join(_coarse(sets), "node"), ["sketch"]))).distinct(), "near-pairs")
    links = _confirm(tried, sets)
    open_ = _open(members, links)
    hubs = _hubs(open_, links).join(_coarse(sets), "node").select("cell", "node", "sketch").repartition("cell").sortWithinPartitions("cell", "node")
    links = table(links.unionByName(_confirm(_trees(hubs).join(tried, ["a", "b"], "left_anti"), sets)), "near-links")
    open_ = _open(open_.drop("component"), links)
    few = open_.where(F.col("size") <= BLOCK)
    many = open_.where(F.col("size") > BLOCK).select("node", "component").distinct()
    links = table(links.unionByName(_across(few, nodes, sets, True)).unionByName(_across(_rare(many, sets), nodes, sets, False)), "near-all-links")
    found = components(links)

    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    out = nodes.drop("sig").join(found, "node", "left").join(ends, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = table(out, "near-placed")
    drop(buckets, members, sets, tried, open_, links, found, nodes)
    return signed, out


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of keys that hold several components of ``links``, with their ``component``."""
    placed = members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    return table(placed.join(mixed, "key", "left_semi"), "near-open")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, ``n_links`` (confirmed links of its set), ``class_size`` (rows with an equal set)."""
    signed, placed = _placed(docs, id_col, text_col)
    smallest = placed.where("n_links > 0").groupBy("component").agg(F.min("rep").alias("least"))
    labels = placed.join(smallest, "component", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_size", F.col("class_size").alias("rows"))
    full = signed.where(F.col("fp").isNotNull())
    empty = signed.where(F.col("fp").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("class_size"))
    named = lookup(full, table(labels, "near-labels"), ["fp"], "rows", signed.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links", "class_size")
    return named.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component, that with the smallest id (nulls last), and all with empty sets.

    A row is known by its id and its set's digest, so rows that share an id, or have none, are decided one by one; of rows
    that share both, that with the largest hash of all its columns stays. Those of components with more than a row are found through a bitmap of ids and only rows that
    hit it are hashed again and joined.
    """
    signed, placed = _placed(docs, id_col, text_col)
    rows = signed.where(F.col("fp").isNotNull()).groupBy("fp", "doc_id").agg(F.count("*").alias("times"))
    sets = table(placed.where("class_size > 1 OR n_links > 0").select("fp", "component", "class_size"), "near-shared")
    rows = table(lookup(rows, sets, ["fp"], "class_size", signed.count()), "near-rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("r")).select(F.col("r.doc_id").alias("least"), F.col("r.fp").alias("of"), F.lit(True).alias("first"))
    told = rows.join(first, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("fp") == F.col("of")), "left").select("doc_id", "fp", "times", F.coalesce("first", F.lit(False)).alias("first"))
    gone = table(told.where("NOT first OR times > 1").select(F.col("doc_id").alias("gone"), F.col("fp").alias("of"), "first"), "near-gone")
    bits = bitmap_bits(gone.count())
    seen = wrap(docs, number=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    seen = mark(seen, F.xxhash64("number"), bitmap(gone.select(F.xxhash64("gone").alias("h")), bits), bits, "hit")
    hit = seen.where("hit").withColumn("fp", _digest("text"))
    on = F.col("number").eqNullSafe(F.col("gone")) & (F.col("fp") == F.col("of"))
    out = seen.where("not hit").select("whole").unionByName(hit.join(gone, on, "left_anti").select("whole"))
    if not gone.where("first").isEmpty():  # repeated rows of which one stays
        tie = F.xxhash64(F.col("whole").cast("string"))  # rows that share id and set may differ in the rest: the same one stays in every run
        once = hit.join(gone.where("first"), on).groupBy("number", "fp").agg(F.max_by("whole", tie).alias("whole"))
        out = out.unionByName(once.select("whole"))
    return unwrap(out, docs.columns)
