"""Features and scores on reports of our own wording."""

import pytest
from pyspark.sql import functions as F

from sievemark.operators import features as fe

STRONG = """# Heap overflow in parse_header
Summary
Version 2.4.1 of the parser on Ubuntu crashes at src/http/parse.c:212 when parse_header() reads past the buffer. See CVE-2021-12345.

Steps to reproduce
1. build with clang
2. run it

```bash
$ ./parser --input crash.bin
```
```c
memcpy(dst, src, len);
```
==1234==ERROR: AddressSanitizer: heap-buffer-overflow
#0 0x4f3a1c in parse_header src/http/parse.c:212
#1 0x4f3b77 in read_request src/http/read.c:88
#2 0x4f1201 in main src/main.c:31
--- a/src/http/parse.c
+++ b/src/http/parse.c
@@ -210,6 +210,7 @@
"""
WEAK = ("Dear security team, it is important to note that this vulnerability could potentially allow attackers. Furthermore it may lead to complete compromise. "
        "This allows an attacker to gain access. You should follow best practices, implement proper validation and use strong passwords. ") * 4


@pytest.fixture(scope="module")
def scored(spark):
    d = spark.createDataFrame([("strong", STRONG), ("weak", WEAK), ("empty", ""), ("null", None)], "id string, text string")
    return {r.id: r for r in fe.score(d).collect()}


def test_features(scored):
    s = scored["strong"]
    assert s.file_paths >= 3 and s.line_refs >= 3 and s.code_blocks == 2 and s.language_ratio == 1.0
    assert s.stack_frames == 3 and s.distinct_cves == 1 and s.has_steps and s.environment and s.depth
    w = scored["weak"]
    assert w.salutation and w.fillers == 8 and w.remediation == 12 and w.overclaims == 4 and w.claims == 4 and w.claim_evidence == 4.0


def test_evidence(scored):
    kinds = {s.type for s in scored["strong"].evidence_signals}
    assert {"CRASH_OUTPUT", "CODE_DIFF", "STACK_TRACE", "CVE_REFERENCE", "FILE_PATH", "LINE_NUMBER", "ENVIRONMENT_DETAIL"} <= kinds
    assert scored["weak"].evidence_signals == []


def test_order_of_scores(scored):
    assert scored["strong"].composite >= scored["weak"].composite + 15
    assert scored["strong"].substance > scored["weak"].substance
    assert scored["weak"].action == "AUTO_CLOSE" and scored["strong"].action in ("PRIORITIZE", "MANUAL_REVIEW", "STANDARD_TRIAGE")


def test_null_is_empty(scored):
    a, b = scored["empty"].asDict(), scored["null"].asDict()
    assert {k: v for k, v in a.items() if k not in ("id", "text")} == {k: v for k, v in b.items() if k not in ("id", "text")}
    assert a["sentence_cv"] == 0.5 and a["type_token"] == 0.0 and a["perplexity"] == 30.0


def test_label_and_action_bands(spark):
    from sievemark.functions import feature_rules as R

    d = spark.createDataFrame([(x,) for x in (0, 20, 21, 24, 25, 35, 36, 39, 40, 50, 51, 54, 55, 64, 65, 66, 80, 81, 100)], "composite long")
    d = d.withColumn("strong_evidence", F.lit(0)).withColumn("authorship", F.lit(50)).withColumn("substance", F.lit(50))
    got = {r.composite: (r.label, r.action) for r in fe.derive(d, (R.ENGINES[-1],)).collect()}
    assert got[20][0] == "LIKELY INVALID" and got[21][0] == "HIGH RISK" and got[35][0] == "HIGH RISK" and got[36][0] == "NEEDS REVIEW"
    assert got[50][0] == "NEEDS REVIEW" and got[51][0] == "REASONABLE" and got[66][0] == "PROMISING" and got[81][0] == "STRONG"
    assert [got[x][1] for x in (24, 25, 39, 40, 54, 55, 64, 65)] == ["AUTO_CLOSE", "CHALLENGE_REPORTER", "CHALLENGE_REPORTER", "STANDARD_TRIAGE", "STANDARD_TRIAGE", "MANUAL_REVIEW", "MANUAL_REVIEW", "PRIORITIZE"]


def test_burstiness_needs_three_terms(spark):
    d = spark.createDataFrame([("XSS here and SQL there",), ("XSS a SQL bb XSS cccccccccccc RCE",)], "t string")
    a, b = (r[0] for r in d.select(fe.burstiness(F.col("t"))).collect())
    import statistics as st

    gaps = [6, 7, 17]
    assert a == 0 and abs(b - min(100, st.pstdev(gaps) / st.mean(gaps) * 50)) < 1e-9


def test_small_scores(spark):
    d = spark.createDataFrame([("curl CVE-2020-1 v1.2.3 GET /x",), ("the application and your-server",)], "text string")
    assert [r[0] for r in d.select(fe.claim_specificity(F.col("text"))).collect()] == [43, 0]
    assert [r.evidence_quality for r in fe.evidence_quality(spark.createDataFrame([("GET /a HTTP/1.1\nHost: x\n",), ("steps to reproduce: think",)], "text string")).collect()] == [20, 0]
    assert fe.consistency(spark.createDataFrame([("buffer overflow in python flask",)], "text string")).first().consistency == 55
