"""Fabricated evidence, impossible facts, patches and payloads: the queries against SQL and hand-made expectations."""

import pytest
from pyspark.sql import functions as F

from sievemark.operators import claims as cl
from sievemark.plans import claim_queries as cq
from sievemark.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*enumerate(cq.TEXTS), (98, None), (99, "")], "k int, text string")


def test_hallucination_by_hand(texts):
    got = {r.k: [(s.type, s.weight) for s in r.signals] for r in cl.hallucination(texts).collect()}
    assert got[0] == [("fabricated_stack_trace", 15), ("fabricated_addresses", 10), ("fabricated_pid", 6)]
    assert got[1] == [] and got[5] == [] and got[98] == got[99] == []
    assert got[2] == [("phantom_exploit_script", 8), ("incomplete_asan", 12), ("implausible_version", 10)]
    assert got[3] == [("phantom_functions", 10), ("fabricated_pid", 6)]
    assert got[4] == [("impact_escalation", 8), ("empty_disclosure_claim", 5)]
    assert got[6] == [("language_confusion", 8), ("repeated_sentences", 6)]
    assert {r.k: r.hallucination for r in cl.hallucination(texts).collect()}[2] == 40


def test_factual_by_hand(texts):
    t = F.col("text")
    w = {r.k: r for r in texts.na.fill("").select("k", cl.placeholder_weight(t).alias("p"), cl.fabricated_output(t).alias("f"), cl.absent_functions(t).alias("a")).collect()}
    assert [w[k].p for k in (7, 8, 9)] == [22, 5, 0]
    assert [w[k].f for k in (10, 11, 12)] == [27, 17, 0]
    assert [w[k].a for k in (13, 14, 0)] == [70, 8, 0]
    got = {r.k: r for r in cl.factual(texts, 2026).collect()}
    assert (got[15].fact_paths, got[15].fact_certificates) == (100, 98) and got[99].factual == got[98].factual == 0
    assert got[15].factual == 10


def test_patches_and_payloads_by_hand(texts):
    p = {r.k: r.p for r in texts.select("k", cl.fabricated_patch(F.coalesce("text", F.lit(""))).alias("p")).collect()}
    assert (p[16], p[17], p[18], p[99]) == (-10, 0, 0, 0)
    got = {r.k: (r.gold, r.gold_bonus) for r in cl.gold_signals(texts).collect()}
    assert got[19] == (["auth_token", "sql_injection_payload", "command_injection_payload", "path_traversal_payload"], 12)
    assert got[20] == (["xss_payload", "ssrf_metadata_target", "filesystem_toctou"], 11)
    assert got[21] == (["xxe_external_entity", "deserialization_gadget", "crypto_misuse"], 10)
    assert got[22] == (["auth_token"], 3) and got[99] == got[98] == ([], 0)
    assert got[23] == (["auth_token", "command_injection_payload", "deserialization_gadget"], 12)


@pytest.mark.parametrize("name", ["hallucination_signals", "hallucination_summary", "factual_scores", "fabricated_patches", "gold_signals"])
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])
