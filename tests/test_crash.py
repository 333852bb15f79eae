"""Crash traces: hand-made expectations, and the queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from sievemark.functions.crash_rules import MARKERS
from sievemark.operators import crash
from sievemark.plans.all import QUERIES, SQL

ROW = "  0x0c047fff80%02x: " + " ".join(["fa"] * 16)
LEGEND = "\nShadow byte legend\n  Addressable:           00\n  Freed heap region:     fd"
UAF = "==31337==ERROR: AddressSanitizer: heap-use-after-free on address 0x6020000000f0 at pc 0x55d0"


def grid(marked, head=UAF, legend=LEGEND):
    return f"{head}\nShadow bytes around the buggy address:\n{ROW % 0}\n=>0x0c047fff8010: {marked}\n\n{ROW % 32}{legend}"


GOOD_ROW = "fa fa fa fa [fd]fd fa fa fa fa fa fa fa fa fa fa"

CASES = [
    # text, frames, good, placeholders, stripped, markers
    (None, 0, 0, 0, False, []),
    ("plain prose about #1 priorities", 0, 0, 0, False, []),
    ("#0 0x51 in ns::Parser::next() src/parser.cc:91\n#1 0x52 in run_all(int) \n  ==7== #2 0x53 in __libc_start_main", 3, 3, 0, False, []),
    ("#0 0x1 libfoo\n#1 0x2 libfoo", 2, 0, 0, False, []),  # too few to judge
    ("#0 0x1 libfoo\n#1 0x2 libfoo\n#2 0x3 parse.c:7", 3, 1, 0, True, []),
    ("frame 0: <no symbol>\nframe 1: < stripped >\nframe 2: a(b) x.c:1\nFRAME 3: b(c) y.rs:2", 4, 2, 2, True, []),  # half are placeholders
    ("> #0 0xGGGG foo(\n> #1 foo( at 0x12\n> #2 bar( here", 3, 2, 1, False, []),
    # offsets
    ("#0 f+0x100 a.c\n#1 g+0x10 b.c\n#2 h+0x1234 c.c", 3, 3, 0, False, []),  # one round one
    ("#0 f+0x100 a.c\n#1 g+0xAB00 b.c", 2, 2, 0, False, ["round_function_offsets"]),
    ("see f+0x100 and g+0x200 in prose", 0, 0, 0, False, []),
    ("#0 in f+0x2 a.c\n#1 in ns::g+0x100001 b.c", 2, 2, 0, False, ["implausible_function_offset"]),
    ("#0 in f+0x4 a.c\n#1 in g+0xfffff b.c\n#2 (lib+0x4abf1a) c.c", 3, 3, 0, False, []),
    # numbering
    ("#0 a.c\n#1 b.c\n#0 c.c\n#1 d.c", 4, 4, 0, False, []),
    ("#0 a.c\n#2 b.c", 2, 2, 0, False, ["frame_numbering_gaps"]),
    ("#3 a.c\n#4 b.c\n#2 b.c\n#3 e.c", 4, 4, 0, False, []),
    # threads
    ("it ran in thread T3", 0, 0, 0, False, ["thread_id_inconsistency"]),
    ("==12==ERROR in thread T3", 0, 0, 0, False, []),
    ("==5000000== x", 0, 0, 0, False, ["implausible_thread_id"]),
    ("==4194304== thread T1024", 0, 0, 0, False, []),
    ("==4194304== thread T1025", 0, 0, 0, False, ["implausible_thread_id"]),
    ("==7== READ of size 8 at 0xab thread T0\nfreed by thread T00\npreviously allocated by thread T0", 0, 0, 0, False, []),
    ("==7== READ of size 8 at 0xab thread T0\nfreed by thread T1\nallocated by thread T1", 0, 0, 0, False, []),
    ("==7== Write of size 8 at 0xab by thread T1\nPrevious read of size 8 at 0xab by thread T2", 0, 0, 0, False, []),  # a race
    ("==7== READ of size 8 at 0xab thread T0\nfreed by thread T1", 0, 0, 0, False, ["thread_role_no_overlap"]),
    ("==7== READ of size 8 at 0xab thread T0, thread T4\nfreed by thread T1\nfreed by thread T2\nallocated by thread T1", 0, 0, 0, False, ["thread_id_mismatch"]),
    # regions
    ("region size: 0x40", 0, 0, 0, False, ["round_heap_region_size"]),
    ("Region size: 1024", 0, 0, 0, False, ["round_heap_region_size"]),
    ("region size: 1024 [0x10,0x20)", 0, 0, 0, False, []),
    ("region size: 1000", 0, 0, 0, False, []),
    ("0-byte region [0x1,0x1)", 0, 0, 0, False, ["region_size_vs_access_size"]),
    ("double-free: WRITE of size 16 in 8-byte region [0x1,0x9)", 0, 0, 0, False, ["region_size_vs_access_size"]),
    ("heap-buffer-overflow: WRITE of size 16 in 8-byte region [0x1,0x9)", 0, 0, 0, False, []),
    # registers: four odd ones and at least half
    ("RAX=0x1000 RBX=0x2000 RCX=0x3000", 0, 0, 0, False, []),
    ("RAX=0x1000 RBX=0x2000 RCX=0x3000 RDX=0xf0000", 0, 0, 0, False, ["fabricated_register_state"]),
    ("x0: 0xdead x1: 0xdead x2: 0x0000dead w3: 0xdead x4: 0x7f12ab34cd56", 0, 0, 0, False, ["fabricated_register_state"]),
    ("rax 0x0 rbx 0x0 rcx 0x0 rdx 0x0 rsi 0x0 r8 0x7f0012345678", 0, 0, 0, False, []),
    ("rax 0x1000 rbx 0x2000 rcx 0x3000 rdx 0x4000 r8 0xab1 r9 0xab2 r10 0xab3 r11 0xab4 r12 0xab5", 0, 0, 0, False, []),
    # memory maps
    ("55f4a1c89000-55f4a1c8a000 r-xp 0\n7f0000000000-7f0000021000 rw-p 0", 0, 0, 0, False, []),
    ("55f4a1c89001-55f4a1c8a000 r-xp 0", 0, 0, 0, False, []),  # one line
    ("55f4a1c8a000-55f4a1c89000 r-xp\n7f0000000000-7f0000021000 rw-p", 0, 0, 0, False, ["fabricated_memory_map"]),
    ("0000f000-00010000 r-xp\n7f0000000000-7f0000021000 rw-p", 0, 0, 0, False, ["fabricated_memory_map"]),
    ("0x7f0000020000-0x7f0000030000 rw-p\n0x7f0000000000-0x7f0000021000 rw-p", 0, 0, 0, False, ["fabricated_memory_map"]),
    # status
    ("VmPeak: 65536 kB\nVmRSS: 2048 kB\nVmStk: 132 kB", 0, 0, 0, False, ["fabricated_proc_status"]),
    ("VmPeak: 65532 kB\nVmRSS: 2048 kB\nVmStk: 256 kB", 0, 0, 0, False, []),
    ("VmPeak: 65536 kB\nVmRSS: 2048 kB", 0, 0, 0, False, []),
    # shadow bytes
    (grid(GOOD_ROW), 0, 0, 0, False, []),
    (grid(GOOD_ROW.replace("fd", "fa")), 0, 0, 0, False, ["shadow_byte_class_mismatch"]),
    (grid(GOOD_ROW, legend="\nthat is all"), 0, 0, 0, False, ["malformed_shadow_bytes"]),
    (grid("fa [fd] fa fa"), 0, 0, 0, False, ["malformed_shadow_bytes"]),
    (grid(GOOD_ROW).replace("=>", "  "), 0, 0, 0, False, ["malformed_shadow_bytes"]),
    (grid(GOOD_ROW.replace("[fd]fd", "fad [fd]")), 0, 0, 0, False, ["malformed_shadow_bytes"]),
    (grid(GOOD_ROW, head="==3==ERROR: AddressSanitizer: something-new on address"), 0, 0, 0, False, []),
    (grid(GOOD_ROW, head="==3==ERROR: AddressSanitizer: SEGV; it is a\tcontainer-overflow"), 0, 0, 0, False, ["shadow_byte_class_mismatch"]),
    ("Shadow bytes around the buggy address:\nnothing", 0, 0, 0, False, ["malformed_shadow_bytes"]),
    ("region size: 256\n==0==", 0, 0, 0, False, ["implausible_thread_id", "round_heap_region_size"]),
]


def test_hand_made_traces(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    got = {r.i: r.x for r in d.select("i", crash.evaluate(F.col("text")).alias("x")).collect()}
    for i, (text, frames, good, held, stripped, markers) in enumerate(CASES):
        x = got[i]
        assert (x.frames, x.good, x.placeholders, x.stripped, sorted(x.markers), x.fabricated) == (frames, good, held, stripped, sorted(markers), len(markers) >= 2), text


def test_each_marker_has_a_case():
    assert {m for c in CASES for m in c[5]} == set(MARKERS)


@pytest.mark.parametrize("name", ["crash_traces", "crash_marker_counts", "hallucination_whole"])
def test_queries_equal_their_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_no_python_worker_and_no_shuffle(spark):
    d = spark.createDataFrame([(1, "x")], "i int, text string").select(crash.evaluate(F.col("text")))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_markers_weigh_in_hallucination(spark):
    from sievemark.operators import claims

    cases = [("#0 a.c\n#2 b.c", 4), ("#0 a.c\n#2 b.c\n==0==", 16), ("plain", 0), ("```\nHTTP/1.1 404 OK\nServer: x\n```", 8)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = {r.i: (r.signal_weight, r.hallucination) for r in claims.hallucination_whole(d).collect()}
    assert got == {i: (w, 100 - 2 * w) for i, (_, w) in enumerate(cases)}
