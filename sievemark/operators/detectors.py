"""Pre-filters, fabrication checks and the fusion of axes: rules as data, native expressions over one text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detector_rules as R
from ..functions.text import count, every, found, js_round, let
from .features import derive


def prefilter(df: DataFrame, text_col: str = "text", year: int = 2026, rejected: DataFrame | None = None) -> DataFrame:
    """Add ``fires`` (family, flag, severity), ``total_severity``, ``quarantined``, ``route`` and ``realness_cap``.

    ``rejected`` is an optional table (id) of withdrawn CVE ids; it is joined by id, whatever its size.
    A null text fires nothing.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    fire = lambda family, flag, severity: F.struct(F.lit(family).alias("family"), F.lit(flag).alias("flag"), F.lit(severity).alias("severity"))
    fires = [F.when(found(t, p, f), fire(family, flag, sev)) for family, flag, sev, p, f in R.PREFILTER]
    loose = F.filter(F.array_distinct(every(t, R.LOOSE_CVE)), lambda c: ~c.rlike(r"^CVE-\d{4}-\d{4,}$"))
    future = F.filter(F.array_distinct(every(t, R.STRICT_CVE)), lambda c: F.substring(c, 5, 4).cast("int") > year)
    cves = F.concat(F.transform(loose, lambda _: fire("cve_validation", "hallucinated_cve_format", 3)), F.transform(future, lambda _: fire("cve_validation", "future_year_cve", 3)))
    d = df.withColumn("fires", F.concat(F.array_compact(F.array(*fires)), cves))
    if rejected is not None:
        keyed = d.withColumn("__row", F.monotonically_increasing_id())
        ids = keyed.select("__row", F.explode(F.array_distinct(every(t, R.STRICT_CVE))).alias("id"))
        hits = ids.join(rejected.select("id").distinct(), "id").groupBy("__row").agg(F.count("*").alias("__n"))
        d = keyed.join(hits, "__row", "left").withColumn("fires", F.concat("fires", F.array_repeat(fire("cve_validation", "rejected_cve", 3), F.coalesce("__n", F.lit(0)).cast("int")))).drop("__row", "__n")
    d = d.withColumn("total_severity", F.aggregate("fires", F.lit(0), lambda a, f: a + f["severity"]).cast("bigint"))
    high = F.exists("fires", lambda f: f["family"].isin(*[k for k, v in R.ROUTES.items() if v[2] == 3]))
    q = F.col("total_severity") >= R.QUARANTINE
    return d.withColumn("quarantined", q).withColumn("route", F.when(q & high, "legal_ir_soc").when(q, "psirt_triage")).withColumn("realness_cap", F.when(q & high, 0.0).when(q, 0.2))


def severity_inflation(text: Column) -> Column:
    """Weight of severity claims without support, impossible CVSS scores and padding by taxonomies."""
    supported = found(text, R.SEVERITY_SUPPORT[0], "i")
    for p in R.SEVERITY_SUPPORT[1:]:
        supported = supported | found(text, p, "i")
    cvss = F.size(F.filter(every(text, R.CVSS, "i", 1), lambda x: x.cast("double") > 10.0))
    cwes, named = count(text, r"cwe-?\d+", "i"), found(text, R.NAMED_CLASS, "i")
    return (
        F.when(found(text, R.SEVERITY_CLAIM, "i") & ~supported, 15).otherwise(0) + cvss * 10 + F.when((cwes >= 5) & ~named, 8).otherwise(0)
        + F.when(found(text, R.OWASP, "i") & (cwes >= 3) & ~named, 6).otherwise(0)
    ).cast("bigint")


def _ids(text: Column) -> Column:
    pair = lambda m: F.struct(F.substring(m, 5, 4).cast("int").alias("year"), F.substring(m, 10, 18).cast("bigint").alias("id"), F.length(m).alias("n"))
    return F.transform(F.regexp_extract_all(text, F.lit(r"CVE-\d{4}-\d{4,}"), F.lit(0)), pair)


def cve_years(text: Column, year: int) -> Column:
    """Weight of CVE ids of impossible years, and of five or more all of one year."""

    def weigh(c: Column) -> Column:
        return (
            F.size(F.filter(c, lambda x: x["year"] > year + 1)) * 20 + F.size(F.filter(c, lambda x: x["year"] < 1999)) * 15
            + F.when((F.size(c) >= 5) & (F.size(F.array_distinct(F.transform(c, lambda x: x["year"]))) == 1), 8).otherwise(0)
        ).cast("bigint")

    return let(_ids(text), weigh)


def fabricated_cves(text: Column, year: int) -> Column:
    """Weight of CVE ids that run in sequence, are round, or are too long."""
    named, templated = found(text, R.RESEARCHER, "i"), found(text, R.TEMPLATED, "i")

    def weigh(c: Column) -> Column:
        ids = F.array_sort(F.transform(c, lambda x: x["id"]))
        n = F.greatest(F.size(c) - 1, F.lit(0))
        steps = F.size(F.filter(F.zip_with(F.slice(ids, 1, n), F.slice(ids, 2, n), lambda a, b: b - a), lambda d: d == 1))
        recent = F.forall(c, lambda x: F.lit(year) - x["year"] <= 1)
        return (
            F.when((F.size(c) >= 2) & (steps >= 2), F.when(named & recent, 0).when(templated, 12).otherwise(5)).otherwise(0)
            + F.when(F.size(F.filter(c, lambda x: x["id"] % 1000 == 0)) >= 2, 10).otherwise(0) + F.size(F.filter(c, lambda x: F.length(x["id"].cast("string")) > 7)) * 8
        ).cast("bigint")

    return let(_ids(text), weigh)


def log_score(weight: Column) -> Column:
    """30 ln(1 + weight), rounded, at most 100."""
    return F.least(F.lit(100), js_round(30 * F.log1p(weight.cast("double")))).cast("bigint")


def fuse(df: DataFrame) -> DataFrame:
    """Axes fused into ``slop_score``, ``tier``, ``quadrant``, ``archetype`` and ``confidence``."""
    return derive(df, R.FUSION)


def cwe_closure(parents: DataFrame, depth: int = 6) -> DataFrame:
    """(cwe, ancestor, distance) up to ``depth`` from an edge table (cwe, parent): one join a level over a table of known size (the CWE list)."""
    out = level = parents.select("cwe", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    for k in range(2, depth + 1):
        level = level.join(parents.select(F.col("cwe").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("cwe", F.col("next").alias("ancestor"), F.lit(k).alias("distance")).distinct()
        out = out.unionByName(level)
    return out.groupBy("cwe", "ancestor").agg(F.min("distance").alias("distance"))
