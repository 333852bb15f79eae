"""Queries of vague phrases and of composites without a family. Base scores are those of the documents; texts of ours, after theirs, have the phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import family_rules as R
from ..functions import triage_rules as T
from ..functions.text import D_SPACE, d_found
from ..operators import families as fa
from . import claim_queries as cq
from .registry import QUERIES, SQL, query, read

TEXTS = (
    "We do  NOT have a\nreproducer, it is in a private fuzzing harness; data may not be encrypted in the modern threat landscape.",
    "It does not appear to be safe. Here is the fix: check the length first.", "I have not enumerated all; no runnable proof. Generated with an AI tool, for a leadership-level discussion.", "A weak security  culture.",
)
_N = len(TEXTS) + 1
_CASE = "CASE " + " ".join(f"WHEN doc_id % {_N} = {k} THEN '{x}'" for k, x in enumerate(TEXTS)) + " ELSE '' END"
_T = f"(SELECT doc_id, coalesce(text, '') || chr(10) || {_CASE} AS t FROM documents)"
_HITS = " + ".join(f"CASE WHEN contains(s, '{p}') THEN 1 ELSE 0 END" for p, _ in R.VAGUE)
_OF = lambda c: " + ".join(f"CASE WHEN contains(s, '{p}') THEN 1 ELSE 0 END" for p, k in R.VAGUE if k == c)
_LOW = f"(SELECT *, regexp_replace(lower(t), '{D_SPACE}', ' ', 'g') AS s, regexp_replace(t, '{D_SPACE}', ' ', 'g') AS u FROM {_T})"


def _marked(spark, sf_dir):
    more = F.lit("")
    for k, x in enumerate(TEXTS):
        more = F.when(F.col("doc_id") % _N == k, x).otherwise(more)
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), more).alias("text"))


@query(f"SELECT doc_id, {', '.join(f'CAST({_OF(c)} AS BIGINT) AS {c}' for c in R.CATEGORIES)} FROM {_LOW}")
def vague_phrases(spark, sf_dir):
    d = _marked(spark, sf_dir).select("doc_id", fa.vague_phrases(F.col("text")).alias("v"))
    of = lambda c: F.size(F.filter("v", lambda v: v["category"] == c)).cast("bigint")
    return d.select("doc_id", *[of(c).alias(c) for c in R.CATEGORIES])


_FAMILY = "CASE WHEN doc_id // 5 % 3 = 0 THEN 'INJECTION' ELSE 'FLAT' END"
_VELOCITY, _TEMPLATE = "-5 * (doc_id % 3)", "CASE WHEN doc_id % 7 = 0 THEN -8 END"
_TOLD = " OR ".join(d_found("u", p, f) for _, p, f in T.DISCLOSURE)
_PATCH = cq.PATCH_SQL


@query(f"""
    WITH a AS (SELECT doc_id, t, u, {_FAMILY} AS family, least({R.VAGUE_MOST}, {R.VAGUE_POINTS} * ({_HITS})) AS haircut, {_VELOCITY} + coalesce({_TEMPLATE}, 0) AS behaviour FROM {_LOW}),
    b AS (SELECT a.*, substance, composite, {_PATCH} AS patch FROM a JOIN ({SQL["composite_score"]}) USING (doc_id)),
    c AS (SELECT *, CAST(least(100, greatest(0, composite + behaviour + patch + CASE WHEN family = 'FLAT' AND haircut >= {R.VAGUE_FROM} THEN {R.VAGUE_COMPOSITE} ELSE 0 END)) AS BIGINT) AS family_composite FROM b)
    SELECT doc_id, family, CAST(haircut AS BIGINT) AS haircut, CAST(least(100, greatest(0, substance - haircut - CASE WHEN {_TOLD} THEN {T.DISCLOSURE_PENALTY} ELSE 0 END)) AS BIGINT) AS flat_substance, family_composite, {R.LABEL} AS family_label FROM c""")
def family_composites(spark, sf_dir):
    """Family and what behaviour takes off are dealt by id."""
    d = _marked(spark, sf_dir).join(QUERIES["composite_score"](spark, sf_dir).select("doc_id", "substance", "composite"), "doc_id")
    slash = lambda f: F.expr(f.replace("//", "div"))
    d = d.withColumns({"family": slash(_FAMILY), "velocity_penalty": F.expr(_VELOCITY), "template_penalty": F.expr(_TEMPLATE)})
    return fa.family_composite(fa.flat_substance(d)).select("doc_id", "family", "haircut", "flat_substance", "family_composite", "family_label")
