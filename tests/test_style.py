"""Style, templates, heuristic and whole assessments: queries against SQL and hand-made expectations."""

import math

import pytest
from pyspark.sql import functions as F

from sievemark.functions.text import mean_cv, pair_runs
from sievemark.operators import claims as cl
from sievemark.operators import style as st
from sievemark.plans import claim_queries as cq
from sievemark.plans import style_queries as sq
from sievemark.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*enumerate(sq.TEXTS), (98, None), (99, "")], "k int, text string")


def test_templates_by_hand(texts):
    got = {r.k: (r.template_names, r.template) for r in st.templates(texts).collect()}
    assert got[0] == (["dear_security_team", "formal_letter"], 100) and got[1] == (["bounty_template", "full_template_headers"], 100)
    assert got[2] == (["dependency_dump", "owasp_padding", "generic_remediation"], 100) and got[5] == ([], 0) and got[98] == got[99] == ([], 0)
    assert got[3] == (["audit_checklist", "generic_sqli_template", "executive_summary_template"], 100)


def test_heuristic_by_hand(texts):
    got = {r.k: (r.slop_points, r.quality_points, r.slop_tier) for r in st.heuristic(texts).collect()}
    assert got[4] == (40, 54, "Questionable")  # five stock phrases, few different words
    assert got[5] == (5, 75, "Clean") and got[99] == (0, 29, "Clean") == got[98]


def test_statistical_by_hand(texts):
    got = {r.k: r for r in st.statistical(texts).collect()}
    # 25 sentences of 7 or 8 words: uniform, many passives, the same pairs again and again.
    g = got[6]
    assert g.long_sentences == 25 and g.variation_part == 70 and g.passive_part == 100 and g.range_part == 60 and g.statistical > 60
    assert got[99].statistical == got[98].statistical == 0


def test_assessment_by_hand(spark):
    d = spark.createDataFrame([(k, cq.TEXTS[k]) for k in (0, 1, 3, 19)], "k int, text string")
    got = {r.k: r for r in cl.assess(d).collect()}
    assert [got[k].fabrication for k in (0, 1, 3, 19)] == [-25, 0, -10, 0] and got[19].gold_bonus == 12 and got[1].gold_bonus == 0
    assert got[19].substance == min(95, got[19].substance_plain + 12)


@pytest.mark.parametrize("name", ["statistical_style", "slop_heuristic", "template_matches", "assessed_reports", "assessed_summary"])
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_variation_is_what_sql_gives_to_the_last_bit(spark, duck):
    """Lengths whose variation is just a threshold: a spread taken in two passes is on the other side of it."""
    lists = [[12, 5, 6, 9, 11, 6, 2, 2, 7], [9, 8, 5, 12, 7, 8, 7], [5, 4, 11, 2, 11, 2, 8, 8, 9], [7, 4, 8, 10, 7, 4, 5, 9, 6], [2, 6, 6, 12, 6], [3], [4, 4]]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(lists)], "k int, n array<int>")
    got = [r.cv for r in d.orderBy("k").select(mean_cv(F.col("n"), 0.0)["cv"].alias("cv")).collect()]
    assert got == [duck.execute(f"SELECT coalesce(list_stddev_pop({n}), 0) / list_avg({n})").fetchone()[0] for n in lists]


def test_equal_pairs_are_added_up(spark):
    d = spark.createDataFrame([(["a b", "c d", "a b", "e f", "a b", "c d"],), (["x", "y"],), ([],)], "p array<string>")
    got = [r.s for r in d.select(pair_runs(F.col("p")).alias("s")).collect()]
    assert got == [pytest.approx(3 * math.log2(3) + 2), 0, 0]
