"""Families and their engines: hand-made expectations, and the queries against their SQL."""

import pytest
from pyspark.sql import functions as F

from sievemark.operators import rubrics as ru
from sievemark.plans.all import QUERIES, SQL

CLASSES = [
    # text, claimed CWEs -> family, confidence, cited, cited family, evidence family and its confidence
    (None, None, ("FLAT", "LOW", None, None, None, None)),
    ("plain", [], ("FLAT", "LOW", None, None, None, None)),
    ("plain", ["79"], ("WEB_CLIENT", "HIGH", "79", "WEB_CLIENT", None, None)),
    ("plain", ["9999", "564"], ("INJECTION", "MEDIUM", "564", "INJECTION", None, None)),  # by an ancestor; the first that maps counts
    ("plain", ["9999", "7777"], ("FLAT", "LOW", "9999", None, None, None)),
    ("a stored XSS", [], ("WEB_CLIENT", "MEDIUM", None, None, "WEB_CLIENT", "MEDIUM")),
    ("a stored XSS", ["416"], ("MEMORY_CORRUPTION", "HIGH", "416", "MEMORY_CORRUPTION", "WEB_CLIENT", "MEDIUM")),
    ("md5 with a static iv", [], ("CRYPTO", "LOW", None, None, "CRYPTO", "LOW")),
    ("md5 with a static iv over tls 1.0", [], ("CRYPTO", "MEDIUM", None, None, "CRYPTO", "MEDIUM")),
    ("md5 only", [], ("FLAT", "LOW", None, None, None, None)),
    ("an http desync", [], ("REQUEST_SMUGGLING", "LOW", None, None, "REQUEST_SMUGGLING", "LOW")),  # one keyword is enough there
]


def test_classes(spark):
    d = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(CLASSES)], "i int, text string, cwes array<string>")
    got = {r.i: (r.family, r.confidence, r.cited, r.cited_family, r.evidence_family, r.evidence_confidence) for r in ru.classify(d, ancestors={"564": ("943", "89")}).collect()}
    assert [got[i] for i in range(len(CLASSES))] == [c[2] for c in CLASSES]


TRACE = "==7==ERROR: AddressSanitizer: heap-use-after-free\n#0 0x4f2a11b in parse src/a.c:4\n#1 0x4f2b90b in read_all(int) src/b.c:7\n#2 0x4f31c3b in main src/c.c:2"
BARE = "==7==ERROR: AddressSanitizer: heap-use-after-free\n#0 0x4f2a11b libx\n#1 0x4f2b90b libx\n#2 0x4f31c3b libx"
WIRE = "POST /q HTTP/1.1{0}Host: h.example.org{0}Content-Length: 6{0}Transfer-Encoding: chunked{0}{0}0"
RUBRICS = [
    # family, text, plain score -> gold, revoked, absent, contradictions, fabricated, score by rubric, substance
    ("FLAT", "anything", 50, None),
    ("MEMORY_CORRUPTION", None, 40, ([], [], ["no_crash_or_sanitizer", "no_size_or_offset", "no_c_source_reference"], [], False, 0, 20)),
    ("MEMORY_CORRUPTION", TRACE + "\n8 bytes", 40, (["asan_or_sanitizer", "stack_trace_with_offset"], [], [], [], False, 68, 54)),  # 34 of 50 points
    ("MEMORY_CORRUPTION", BARE + "\n8 bytes in a.c, p->len", 60, (["specific_struct_field"], ["asan_or_sanitizer", "stack_trace_with_offset"], [], [], True, 0, 30)),
    ("MEMORY_CORRUPTION", "valgrind, 8 bytes in a.c, p->len", 60, (["specific_struct_field"], [], [], [], False, 12, 48)),  # little by rubric, nothing against it
    ("MEMORY_CORRUPTION", "valgrind, 8 bytes in a.c, p->len; or 1=1 and <script>", 60, (["specific_struct_field"], [], [], ["<script>", "or 1=1"], False, 0, 30)),
    ("MEMORY_CORRUPTION", "valgrind, 8 bytes in a.c, p->len\n```\nor 1=1\n```", 60, (["specific_struct_field"], [], [], [], False, 12, 36)),  # only in code: not taken off, but not spared either
    ("INJECTION", "' + name, union select 1 at https://h", 30, (["concrete_payload", "vulnerable_query_construction"], [], [], [], False, 84, 57)),
    ("INJECTION", "payload: <insert here>; union select 1 at https://h", 30, ([], ["concrete_payload"], [], [], True, 0, 15)),
    ("INJECTION", "payload: <insert here>; `union select 1` at https://h", 30, (["concrete_payload"], [], [], [], False, 63, 46)),  # code is left
    ("REQUEST_SMUGGLING", WIRE.format("\r\n") + " nginx", 30, (["raw_http_request", "te_or_cl_conflict", "specific_proxy_or_server"], [], [], [], False, 84, 57)),
    ("REQUEST_SMUGGLING", WIRE.format("\n") + " nginx", 30, (["specific_proxy_or_server"], ["raw_http_request", "te_or_cl_conflict"], [], [], True, 8, 19)),
    ("AUTHN_AUTHZ", WIRE.format("\n") + " nginx; alice and bob", 30, (["two_account_proof"], [], [], [], False, 52, 41)),  # there line ends do not matter
    ("WEB_CLIENT", "reflected in the page\nHTTP/1.1 200 OK\nX: y\n\n<script>alert(1)</script>", 30, ([], ["concrete_payload", "reflection_or_dom_proof"], ["no_url"], [], True, 0, 15)),
    ("WEB_CLIENT", "reflected in the page, <script>alert(1)</script> https://h.org/a\nHTTP/1.1 200 OK\nX: y\n\nfine", 30, (["concrete_payload"], ["reflection_or_dom_proof"], [], [], True, 14, 22)),
]


def test_rubrics(spark):
    d = spark.createDataFrame([(i, f, t, s) for i, (f, t, s, _) in enumerate(RUBRICS)], "i int, family string, text string, substance int")
    got = {r.i: r for r in ru.substance(d).collect()}
    for i, (family, text, _, want) in enumerate(RUBRICS):
        r = got[i]
        if want is None:
            assert r.rubric is None and r.family_substance is None
            continue
        x = r.rubric
        assert (sorted(x.gold), sorted(x.revoked), x.absent, x.contradictions, x.fabricated, r.rubric_score, r.family_substance) == (sorted(want[0]), sorted(want[1]), *want[2:]), (family, text, r)


COHERENT = [
    # text, claimed, -> rule, score
    ("plain", [], "", 42),
    ("XSS", ["416"], "OFF_FAMILY_CEILING", 25 - 14),  # neither impact nor tools of the family
    ("use after free, memory corruption under gdb", ["416"], "SAME_FAMILY_NO_CONCRETE_EVIDENCE", 32),
    ("use after free, memory corruption under gdb, p->len and cwe-416", ["416"], "SAME_FAMILY_FLOOR", 75 + 3),
    ("use after free, memory corruption under gdb", [], "SOFT_CITATION", 60),
    ("use after free, memory corruption under gdb, <script>", [], "SOFT_CITATION", 60),  # a script names XSS first
    ("memory corruption under gdb, or 1=1", ["416"], "CITED_NO_EVIDENCE", None),
    ("md5 with a static iv, forgery by openssl enc", [], "SAME_FAMILY_FLOOR", None),
    ("mutex and atomicity violation, race window, loop 5", [], "SAME_FAMILY_NO_CONCRETE_EVIDENCE", 32),
]


def test_coherence(spark):
    d = spark.createDataFrame([(i, t, c, 42) for i, (t, c, *_) in enumerate(COHERENT)], "i int, text string, cwes array<string>, coherence int")
    got = {r.i: (r.base_rule or "", r.family_coherence) for r in ru.coherence(ru.classify(d)).collect()}
    for i, (text, _, rule, score) in enumerate(COHERENT):
        if text.endswith("<script>") or "or 1=1" in text:
            continue
        assert got[i][0] == rule and (score is None or got[i][1] == score), (text, got[i])


@pytest.mark.parametrize("name", ["report_families", "family_coherences", "family_rubrics", "evidence_flags", "family_reports", "family_actions"])
def test_queries_equal_their_sql(name, same):
    same(QUERIES[name], SQL[name])
