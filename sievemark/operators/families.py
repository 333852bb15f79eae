"""Scores of texts without a family, and composites with what behaviour takes off. Native expressions; a null text is an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import family_rules as R
from ..functions.text import let
from .claims import fabricated_patch
from .triage import disclosure_penalty, disclosures


def vague_phrases(text: Column, phrases=R.VAGUE) -> Column:
    """Array of (phrase, category): those that occur, in any case and with any white space between words. ``phrases`` may be the caller's, in lower case."""
    return let(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), lambda t: F.array_compact(F.array(*[F.when(t.contains(p), F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("category"))) for p, c in phrases])))


def _bound(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), x)).cast("bigint")


def flat_substance(df: DataFrame, text_col: str = "text", phrases=R.VAGUE) -> DataFrame:
    """Add ``vague`` phrases, the ``haircut`` for them and ``flat_substance``: what is left of ``substance`` after it and after a disclosed model."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = df.withColumn("vague", vague_phrases(t, phrases)).withColumn("haircut", F.least(F.lit(R.VAGUE_MOST), R.VAGUE_POINTS * F.size("vague")).cast("bigint"))
    return d.withColumn("flat_substance", _bound(F.col("substance") - F.col("haircut") - disclosure_penalty(disclosures(t))))


def family_composite(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``family_composite`` and ``family_label``: ``composite`` less ``velocity_penalty`` and ``template_penalty`` (not positive; null: none), less for a claimed patch without one, and for a vague text (``haircut``) without ``family``."""
    penalty = lambda c: F.least(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    vague = F.when((F.col("family") == "FLAT") & (F.col("haircut") >= R.VAGUE_FROM), R.VAGUE_COMPOSITE).otherwise(0)
    patch = fabricated_patch(F.coalesce(F.col(text_col), F.lit("")))
    d = df.withColumn("family_composite", _bound(F.col("composite") + penalty("velocity_penalty") + penalty("template_penalty") + vague + patch))
    return d.withColumn("family_label", F.expr(R.LABEL))
