"""Conversation prefix trie by partition refinement.

Conversations that begin alike share the nodes of their common turns. All of
them start in one class, the root. A round reads the next turn of the active
conversations and splits their classes by it; every part is a node. Classes
whose conversations are the same to the end, singletons above all, are retired:
the turns left are a unary chain, written from the smallest member's own rows
in one step, however long. So there are as many rounds as the longest prefix
that different conversations share, and after :data:`SINGLE` rounds one takes
up to :data:`BLOCK` turns at a time.

Folding back needs no rounds. A conversation owns the nodes of which it is the
smallest member; they are one path down to its end. What a node's subtree adds
up to is what its members' own paths do, less the owner's part above the node:
one aggregate over (conversation, node) rows, combined before the shuffle.

Turn positions come from a range sort with one count a partition, not from a
window over a conversation, so a conversation with a third of all turns is dealt
over many tasks; the digests of a node's ended members are fed to SHA-256 from
sorted rows one by one.

Defined results: turns go by turn (null first), then role and text; a null role
or text is the empty one; rows with a null conv_id belong to no conversation;
repeated rows are turns of their own; an empty table has no node; columns of
other names are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lookup, table

#: A donor's turns that a conversation may begin with are fewer than this.
DONATED = 9
#: Conversations in a group that share a donor, its first.
GROUP = 5
#: Rounds of one turn each; from then on a round takes more, up to BLOCK.
SINGLE, BLOCK = 16, 64

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def positions(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, a, b, bytes, before): place in the conversation from 1, 128-bit digest of role and text, UTF-8 bytes of the text and of all texts before it."""
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    hashed = own.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.octet_length("text").cast("bigint").alias("bytes"), F.spark_partition_id().alias("part"))

    def count(batches):
        at = conv = None
        for batch in batches:
            pos, before = [], []
            convs, sizes = batch.column("conv_id").to_pylist(), batch.column("bytes").to_pylist()
            for c, n in zip(convs, sizes):
                if c != conv or at is None:
                    conv, at, size = c, 0, 0
                at += 1
                pos.append(at)
                before.append(size)
                size += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("conv_id", "a", "b", "bytes", "part")] + [pa.array(pos, pa.int64()), pa.array(before, pa.int64())], names=["conv_id", "a", "b", "bytes", "part", "pos", "before"])

    local = table(hashed.mapInArrow(count, "conv_id long, a long, b long, bytes long, part int, pos long, before long"), "trie-turns")
    # A conversation can begin in one partition of the range and go on in the next ones: one row a partition says how it ends.
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos", (F.col("before") + F.col("bytes")).alias("size"))).alias("last")).orderBy("part").collect()
    carry, conv, pos, size = [], None, 0, 0
    for e in ends:
        joined = conv == e["first"]
        if joined:
            carry.append((e["part"], conv, pos, size))
        more = joined and e["last"]["conv_id"] == conv
        conv, pos, size = e["last"]["conv_id"], e["last"]["pos"] + (pos if more else 0), e["last"]["size"] + (size if more else 0)
    if not carry:
        return local.drop("part")
    carried = turns.sparkSession.createDataFrame(carry, "part int, conv_id long, __pos long, __size long")  # at most one row a partition
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return local.join(F.broadcast(carried), ["part", "conv_id"], "left").select("conv_id", (F.col("pos") + more("__pos")).alias("pos"), "a", "b", "bytes", (F.col("before") + more("__size")).alias("before"))


def own(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conversations, turns) as :func:`rebuilt` gives them."""
    placed = table(positions(turns), "trie-placed")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("len"), F.sum("bytes").alias("total"))
    every = lookup(placed, sizes.withColumn("rows", F.col("len")), ["conv_id"], "rows", placed.count())
    return _with_digests(sizes.select("conv_id", "len"), table(every.select("conv_id", F.col("pos").alias("d"), "a", "b", "bytes", (F.col("total") - F.col("before")).alias("rest")), "trie-rows"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of which each begins with its donor's first turns.

    Returns conversations (conv_id, len, x, y: 128-bit digest of all turns) and turns (conv_id, d: depth from 1, a, b, bytes,
    rest: bytes of this text and all after it).
    """
    placed = table(positions(turns), "trie-placed")
    head = F.when(F.col("pos") < DONATED, F.struct("pos", "a", "b", "bytes"))
    facts = placed.groupBy("conv_id").agg(F.count("*").alias("len"), F.sum("bytes").alias("total"), F.array_sort(F.collect_list(head)).alias("head"))
    facts = table(facts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % DONATED).withColumn("donor", F.col("conv_id") - F.col("conv_id") % GROUP), "trie-facts")
    given = facts.select(F.col("conv_id").alias("donor"), F.col("head").alias("from_donor"))
    size = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, t: s + t["bytes"])
    first = F.slice(F.coalesce(F.col("from_donor"), F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    facts = facts.join(given, "donor", "left").withColumn("first", first)
    facts = facts.withColumn("tail", F.col("total") - size(F.slice("head", F.lit(1), F.col("h").cast("int")))).withColumn("shift", F.size("first") - F.col("h"))
    facts = table(facts.withColumn("rebuilt_len", F.size("first") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "trie-plans")
    donated = facts.select("conv_id", "tail", "first", F.posexplode("first").alias("i", "t")).select(
        "conv_id", (F.col("i") + 1).cast("bigint").alias("d"), "t.a", "t.b", "t.bytes", (size(F.slice("first", F.col("i") + 1, F.lit(DONATED))) + F.col("tail")).alias("rest"))
    plan = facts.select("conv_id", "h", "shift", "total", F.col("len").alias("rows"))
    kept = lookup(placed, plan, ["conv_id"], "rows", placed.count()).where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("d"), "a", "b", "bytes", (F.col("total") - F.col("before")).alias("rest"))
    rows = table(donated.unionByName(kept), "trie-rows")
    drop(placed)
    return _with_digests(facts.select("conv_id", F.col("rebuilt_len").cast("bigint").alias("len")), rows)


def _with_digests(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    whole = rows.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("d", "a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", "d")).alias("y"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return table(convs.join(whole, "conv_id", "left").select("conv_id", "len", zero("x"), zero("y")), "trie-convs"), rows


def _classes(members: DataFrame) -> DataFrame:
    """The nodes of (conversation, class) rows: one row per class (d, p, q) with its members' number, smallest and whether they are the same to the end."""
    return members.groupBy("d", "p", "q").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.max("len").alias("len"),
        ((F.min("x") == F.max("x")) & (F.min("y") == F.max("y")) & (F.min("len") == F.max("len"))).alias("alike"))


def _block(members: DataFrame, rows: DataFrame, depth: int, turns: int) -> DataFrame:
    """(conversation, class) rows at the next ``turns`` depths of active ``members``."""
    new = members.join(rows.where((F.col("d") > depth) & (F.col("d") <= depth + turns)).select("conv_id", "d", "a", "b", "bytes"), "conv_id")
    if turns == 1:
        key = [F.xxhash64("p", "q", "a", "b"), F.xxhash64("b", "q", "p", "a")]
    else:  # a prefix of at most BLOCK turns of one conversation
        path = F.collect_list(F.struct("a", "b")).over(Window.partitionBy("conv_id").orderBy("d"))
        key = [F.xxhash64("p", "q", path), F.xxhash64(path, "q", "p")]
    return new.select("conv_id", "len", "x", "y", "d", key[0].alias("p"), key[1].alias("q"), F.col("owner").alias("parent"), "bytes")


def trie(convs: DataFrame, rows: DataFrame, single: int = SINGLE, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``convs`` and ``rows`` as :func:`rebuilt` gives them: see :func:`prefix_trie`."""
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    members = table(convs.select("*", zero.alias("d"), zero.alias("p"), zero.alias("q"), none.alias("parent"), zero.alias("bytes")), "trie-members")
    all_members, all_classes, left = [members], [], []
    depth, step, rounds = 0, 1, 0
    total = members.count()
    while total:
        # In a block of several turns a class counts where its own members leave it or the block ends.
        classes = table(_classes(members), "trie-classes")
        all_classes.append(classes)
        last = depth if not rounds else depth + step
        deepest = members.where(F.col("d") == last)
        open_classes = classes.where((F.col("d") == last) & ~F.col("alike")).select("p", "q", "owner", "n")
        left.append(members.where(F.col("d") == F.col("len")).select("conv_id", "d", "p", "q"))
        shut = classes.where((F.col("d") == last) & F.col("alike") & (F.col("len") > last)).select("p", "q", F.col("d").alias("at"), "n")
        left.append(lookup(deepest.where(F.col("len") > F.col("d")).select("conv_id", "d", "p", "q"), shut, ["p", "q"], "n", total).drop("at"))
        active = table(lookup(deepest.where(F.col("len") > F.col("d")).select("conv_id", "len", "x", "y", "p", "q"), open_classes, ["p", "q"], "n", total), "trie-active")
        depth, rounds = last, rounds + 1
        if rounds > single:
            step = min(2 * step, block)
        members = table(_block(active, rows, depth, step), "trie-members")
        if step > 1:
            members = table(_parents(members, depth), "trie-members")
        total = members.count()
        all_members.append(members)
    if not all_classes:
        return _empty(convs)
    return _fold(rows, _union(all_members), table(_union(all_classes), "trie-nodes"), table(_union(left), "trie-left"))


def _parents(members: DataFrame, depth: int) -> DataFrame:
    """Members of a block with, below its first depth, the owner of the class one depth up."""
    up = members.groupBy("d", "p", "q").agg(F.min("conv_id").alias("owner"), F.count("*").alias("rows"))
    above = members.select("conv_id", (F.col("d") + 1).alias("d"), F.col("p").alias("pp"), F.col("q").alias("qq"))
    inner = members.where(F.col("d") > depth + 1).drop("parent").join(above, ["conv_id", "d"])
    named = lookup(inner.withColumn("dd", F.col("d") - 1), up.select(F.col("d").alias("dd"), F.col("p").alias("pp"), F.col("q").alias("qq"), F.col("owner").alias("parent"), "rows"), ["dd", "pp", "qq"], "rows", members.count())
    return members.where(F.col("d") == depth + 1).unionByName(named.select(*members.columns))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ends(left: DataFrame) -> DataFrame:
    """Per class the SHA-256 of its conversations' ids, ascending: one pass over sorted rows, whatever a class holds."""

    def digest(batches):
        key, sha = None, None
        out = []
        for batch in batches:
            for c, d, p, q in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "d", "p", "q"))):
                if (d, p, q) != key:
                    if sha is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, p, q), hashlib.sha256(str(c).encode())
                else:
                    sha.update(f",{c}".encode())
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if sha is not None:
            out.append((*key, sha.hexdigest()))
        if out:
            yield _batch(out)

    def _batch(out):
        d, p, q, sha = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(sha)], names=["d", "p", "q", "ends"])

    return left.repartition(F.col("p"), F.col("q")).sortWithinPartitions("p", "q", "d", "conv_id").mapInArrow(digest, "d long, p long, q long, ends string")


def _fold(rows: DataFrame, members: DataFrame, classes: DataFrame, left: DataFrame) -> DataFrame:
    """Nodes of the classes and of the chains below those that were retired, with what their subtrees add up to."""
    # Classes that end a path: alike, and not below another such one (inside a block they go on until its end).
    tops = classes.where("alike").groupBy("owner").agg(F.max("d").alias("d"))
    ended = table(_ends(left), "trie-ends")
    classes = table(classes.join(ended, ["d", "p", "q"], "left").join(tops.withColumn("shut", F.lit(True)), ["owner", "d"], "left").withColumn("shut", F.coalesce("shut", F.lit(False))), "trie-closed")
    chains = classes.where("shut and len > d").select("owner", F.col("d").alias("at"), "n", F.col("len").alias("end"), "ends")
    tail = lookup(rows.withColumnRenamed("conv_id", "owner"), chains.withColumn("rows", F.col("end")), ["owner"], "rows", rows.count()).where("d > at")
    tail = tail.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("owner").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("d") < F.col("end")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("d") == F.col("end"), F.col("ends")).otherwise(F.lit(_EMPTY_SHA)).alias("ends_sha256"))
    first = tail.join(chains.select(F.col("owner").alias("conv_id"), (F.col("at") + 1).alias("depth")), ["conv_id", "depth"]).select("conv_id", F.col("saved_tokens").alias("chain"))
    value = (F.col("n") - 1) * F.col("bytes")
    paths = classes.groupBy("owner").agg(F.sum(value).alias("nodes"), F.max(F.col("shut").cast("bigint")).alias("leaf")).withColumnRenamed("owner", "conv_id")
    paths = table(paths.join(first, "conv_id", "left").select("conv_id", (F.col("nodes") + F.coalesce("chain", F.lit(0))).alias("path"), "leaf"), "trie-paths")
    under = members.select("conv_id", "d", "p", "q").join(paths, "conv_id").groupBy("d", "p", "q").agg(F.sum("path").alias("paths"), F.sum("leaf").alias("n_leaves"))
    children = classes.where("parent is not null").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("owner")).agg(F.count("*").alias("split"))
    above = F.sum(value).over(Window.partitionBy("owner").orderBy("d")) - value  # a path of shared depths
    nodes = classes.withColumn("above", above).join(under, ["d", "p", "q"]).join(children, ["d", "owner"], "left").select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.coalesce("split", F.lit(0)) + F.when(F.col("shut") & (F.col("len") > F.col("d")), 1).otherwise(0)).cast("bigint").alias("n_children"),
        "n_leaves", (F.col("paths") - F.col("above")).alias("saved_tokens"),
        F.when(F.col("shut") & (F.col("len") > F.col("d")), F.lit(_EMPTY_SHA)).otherwise(F.coalesce("ends", F.lit(_EMPTY_SHA))).alias("ends_sha256"))
    return nodes.unionByName(tail)


def _empty(convs: DataFrame) -> DataFrame:
    return convs.limit(0).select(*[F.lit(None).cast("bigint").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit(None).cast("string").alias("ends_sha256"))


def prefix_trie(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turn, role, text).

    Per node: conv_id (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves of its subtree,
    saved_tokens (bytes that its subtree's texts are shared), ends_sha256 (of the ids of members that end here). With
    ``rebuild`` a conversation begins with turns of its group's first one, otherwise it is taken as it is.
    """
    return trie(*(rebuilt if rebuild else own)(turns))
