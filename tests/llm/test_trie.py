"""The conversation trie against brute force and its SQL."""

import hashlib
import random
import zlib

from sievemark.llm import prefix_trie
from sievemark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos long, d long, p long, part int, owner string"


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, l in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + l[h:]) if h else tuple(l)
    nodes = {}
    for c, l in seqs.items():
        for d in range(len(l) + 1):
            nodes.setdefault(l[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for k, m in nodes.items():
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, m in nodes.items():
        own_saved = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + own_saved
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in children)
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in sorted(m) if seqs[c] == k).encode()).hexdigest())
        for k, m in nodes.items())


def held(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def test_query_equals_sql(same):
    same(QUERIES["op12_prefix_trie"], ORACLE_SQL["op12_prefix_trie"])


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", "hello"), (5, 0, "user", "hello"), (5, 1, "assistant", "ünï"), (6, 0, "user", ""), (7, None, "user", "x" * 5000)]
    rows += [(10 + k, t, "user", f"turn {t}") for k in range(12) for t in range(4)]  # copies
    rows += [(40, t, "assistant", f"turn {t}") for t in range(3)] + [(98, 0, "user", "short"), (101, 0, None, "short")]
    d = made(spark, rows)
    assert held(prefix_trie.prefix_trie(d)) == brute(rows)
    assert prefix_trie.prefix_trie(d.where("conv_id is null")).count() == 0


def test_random_tries_at_every_block_size(spark):
    rng = random.Random(3)
    rows = []
    for c in range(150):
        depth = rng.choice([1, 2, 4, 7])
        rows += [(c, t, "u" if t % 2 else "a", rng.choice("ab") if rng.random() < 0.25 else "same") for t in range(depth)]
    rng.shuffle(rows)
    d = made(spark, rows)
    want = brute(rows, False)
    convs, turns = prefix_trie.own(d)
    for single, block in ((16, 64), (0, 4)):
        assert held(prefix_trie.trie(convs, turns, single, block)) == want


def test_long_shared_prefix_and_hot_conversation(spark):
    rows = [(0, t, "u", f"t{t % 7}") for t in range(300)] + [(1, t, "u", f"t{t % 7}") for t in range(300)] + [(2, t, "u", f"t{t % 7}" if t < 60 else "other") for t in range(80)] + [(3, 0, "u", "alone")]
    assert held(prefix_trie.trie(*prefix_trie.own(made(spark, rows).repartition(5)), 1, 64)) == brute(rows, False)
