"""Vulnerability classes, the second opinion of a language model (its answers are columns), scores of checks and flags of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import triage_rules as R
from ..functions.claim_rules import PLACEHOLDER_DOMAINS
from ..functions.text import count, every, found, java, let
from .features import derive


def vuln_class(text: Column, low: str | Column | None = None) -> Column:
    """Struct of the class with the largest share of its patterns in the text (name, label) and the confidence; without any, unknown with 0."""
    shares = [
        F.struct((sum((F.when(found(text, p, f, low), 1).otherwise(0) for p, f in patterns), F.lit(0)) / len(patterns)).alias("share"), F.lit(-i).alias("i"), F.lit(name).alias("name"), F.lit(label).alias("label"))
        for i, (name, (label, patterns)) in enumerate(R.CLASSES.items())
    ]

    def answer(best: Column) -> Column:
        s, none = best["share"], [F.lit(x) for x in R.UNKNOWN]
        sure = F.when(s >= 0.4, 0.9).when(s >= 0.2, 0.6).when(s > 0, 0.3).otherwise(0.0)
        return F.struct(F.when(s > 0, best["name"]).otherwise(none[0]).alias("name"), F.when(s > 0, best["label"]).otherwise(none[1]).alias("label"), sure.alias("confidence"))

    return let(F.array_max(F.array(*shares)), answer)


def gate(df: DataFrame) -> DataFrame:
    """Add ``reason`` and ``asked``: whether a language model is to be asked about a row."""
    return derive(df, R.GATE)


def blend(df: DataFrame) -> DataFrame:
    """Add ``validity`` of both opinions, and how it came about: ``capped`` (a claim without evidence does not gain), ``floored`` (far apart: the lower one), ``higher``."""
    return derive(df, R.BLEND).drop("__raw")


def without_model(df: DataFrame) -> DataFrame:
    """The fused scores anew from stored axes, as if no model had been asked."""
    return derive(df, R.WITHOUT_MODEL)


def verification(checks: Column) -> Column:
    """Score of weighted checks (structs with ``weight``; negative is good, 50 neutral). A single bad sign gives 40 at most, three good ones and no bad one 10 less 5 for each. No checks: 50."""
    w = F.coalesce(F.transform(checks, lambda c: F.coalesce(c["weight"].cast("bigint"), F.lit(0).cast("bigint"))), F.array().cast("array<bigint>"))

    def score(a: Column) -> Column:
        bad, good, total = F.size(F.filter(a, lambda x: x > 0)), F.size(F.filter(a, lambda x: x < 0)), F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.when((good >= 3) & (bad == 0), F.greatest(F.lit(0), 10 - 5 * good)).when((bad < 2) & (total > 0), 40).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), 50 + total))).cast("bigint")

    return let(w, score)


_RESULTS = "struct<engines: array<struct<engine: string, signalBreakdown: struct<avri: struct<rawHttp: struct<isFake: boolean>, crashTrace: struct<isStripped: boolean>>>>>>"


def fabricated_flags(results: Column) -> Column:
    """Struct (fake_raw_http, stripped_crash_trace) of the first substance engine in stored results (JSON text); false where anything is missing."""

    def flags(engines: Column) -> Column:
        own = F.get(F.filter(engines, lambda e: F.coalesce(F.lower(e["engine"]).contains("technical substance"), F.lit(False))), F.lit(0))["signalBreakdown"]["avri"]
        true = lambda c: F.coalesce(c, F.lit(False))
        return F.struct(true(own["rawHttp"]["isFake"]).alias("fake_raw_http"), true(own["crashTrace"]["isStripped"]).alias("stripped_crash_trace"))

    return let(F.from_json(results, _RESULTS)["engines"], flags)


def disclosures(text: Column, rules=R.DISCLOSURE) -> Column:
    """Names of the rules (name, pattern, flags; further ones may be added) by which a text says that a model wrote it."""
    named = lambda t, low: F.array_compact(F.array(*[F.when(found(t, p, f, low), F.lit(n)) for n, p, f in rules]))
    return let(F.regexp_replace(text, r"(?U)\s+", " "), lambda t: let(F.lower(t), lambda low: named(t, low)))


def disclosure_penalty(names: Column) -> Column:
    return F.when(F.size(names) > 0, R.DISCLOSURE_PENALTY).otherwise(0).cast("bigint")


def coherence_issues(text: Column, family: Column) -> Column:
    """Array of (id, penalty): what a text of a family lacks, and what its CVSS contradicts. None for FLAT; of an unknown family only the score's language is looked at."""

    def issues(x: Column) -> Column:
        t, fam, vector = x["t"], x["family"], x["vector"]
        base = F.when(vector == "", F.regexp_extract(t, java(*R.CVSS_SCORE), 1)).otherwise(F.regexp_extract(t, java(*R.CVSS_SCORE_FAR), 1))
        field = lambda k: F.coalesce(F.try_element_at(F.transform(F.filter(F.split(vector, "/"), lambda p: p.rlike(f"^{k}:[^:]")), lambda p: F.split(p, ":")[1]), F.lit(-1)), F.lit(""))
        lacks = lambda k: F.coalesce(sum((F.when((fam == n) & ~found(t, ps[k], "i"), 1).otherwise(0) for n, ps in R.FAMILIES.items()), F.lit(0)) > 0, F.lit(False))
        odd = F.when((fam == "WEB_CLIENT") & (field("UI") == "N") & found(t, *R.XSS_WORDS), R.CVSS_PENALTY).when((fam == "MEMORY_CORRUPTION") & ~field("AV").isin("", "N", "L"), R.CVSS_PENALTY).when(
            (fam == "AUTHN_AUTHZ") & (field("PR") == "N") & found(t, *R.POWER_WORDS), R.PR_PENALTY)
        hedged = (F.when(base == "", None).otherwise(base).cast("double") >= R.CRITICAL) & found(t, *R.HEDGED)
        one = lambda name, points: F.when(points.isNotNull(), F.struct(F.lit(name).alias("id"), points.cast("bigint").alias("penalty")))
        found_ = F.array(
            one("FAMILY_VS_IMPACT", F.when(lacks(0), R.NO_IMPACT)), one("FAMILY_VS_REPRO", F.when(lacks(1), R.NO_REPRO)), one("CVSS_VS_FAMILY", odd), one("CVSS_VS_LANGUAGE", F.when(hedged, R.HEDGED_PENALTY)),
        )
        return F.when(F.coalesce(fam, F.lit("")) == "FLAT", F.array().cast("array<struct<id: string, penalty: bigint>>")).otherwise(F.array_compact(found_))

    return let(F.struct(text.alias("t"), family.alias("family"), F.regexp_extract(text, java(*R.CVSS_VECTOR), 1).alias("vector")), issues)


def poc_checks(text: Column) -> Column:
    """Array of (type, weight) for :func:`verification`: commands with a textbook payload against a placeholder host, and answers without headers."""
    hosts = [h for h in PLACEHOLDER_DOMAINS if h.endswith((".com", ".org", ".net"))]

    def staged(c: Column) -> Column:
        host, payload = F.lit(False), F.lit(False)
        for h in hosts:
            host = host | F.lower(c).contains(h)
        for p in R.TEXTBOOK:
            payload = payload | found(c, p, "i")
        return host & payload

    first = lambda rule, n: F.slice(every(text, *rule), F.lit(1), F.lit(n))
    check = lambda kind: lambda _: F.struct(F.lit(kind).alias("type"), F.lit(R.POC_WEIGHTS[kind]).cast("bigint").alias("weight"))
    commands = F.filter(first(R.POC_COMMAND, R.POC_COMMANDS), staged)
    answers = F.filter(first(R.POC_RESPONSE, R.POC_RESPONSES), lambda b: (count(b, *R.HEADER) < 2) & ~found(b, *R.REAL_HEADER))
    return F.concat(F.transform(commands, check("poc_placeholder_textbook")), F.transform(answers, check("poc_fabricated_response")))
