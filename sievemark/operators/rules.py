"""Scores by rules that the caller supplies: phrases, stylometry, CWE coherence, families, questions.

Rules are Python lists (they become literals of one projection) where they are a
few hundred at most, and tables where they are joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, count, found, js_round

#: Multipliers by number of formulaic hits, and beyond; agent rules: limits and confidence. Fixed values.
COMPOUND, COMPOUND_MORE = (1.0, 1.0, 1.3, 1.7, 2.2, 2.5, 2.8), 3.0
AGENT_RULES, AGENT_LEAST, AGENT_FULL, AGENT_MOST = 6, 5, 18, 0.95
#: Longest pattern and range of weights of a rule that users add.
PATTERN_CHARS, WEIGHTS = 500, (1, 10)


def checked(rules: Sequence[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Rules (group, pattern, weight) within the limits; others raise."""
    import re

    for group, pattern, weight in rules:
        if not group or not 0 < len(pattern) <= PATTERN_CHARS or not WEIGHTS[0] <= weight <= WEIGHTS[1]:
            raise ValueError(f"bad rule: {group!r}, {pattern[:40]!r}, {weight}")
        re.compile(pattern)
    return list(rules)


def phrase_score(text: Column, phrases: Sequence[tuple[str, int]], formulaic: Sequence[tuple[str, int]]) -> Column:
    """30 ln(1 + weight) of the phrases and formulaic patterns a text has, times a multiplier for many formulaic ones: 0 to 100."""
    low = F.lower(text)
    base = sum((F.when(low.contains(p), w).otherwise(0) for p, w in phrases), F.lit(0))
    hits = [found(text, p, "i") for p, _ in formulaic]
    n = sum((F.when(h, 1).otherwise(0) for h in hits), F.lit(0))
    more = sum((F.when(h, w).otherwise(0) for h, (_, w) in zip(hits, formulaic)), F.lit(0))
    factor = F.lit(COMPOUND_MORE)
    for k, m in reversed(list(enumerate(COMPOUND))):
        factor = F.when(n == k, m).otherwise(factor)
    return F.least(F.lit(100), js_round(30 * F.log1p((base + more) * factor))).cast("bigint")


def stylometry(df: DataFrame, rules: Sequence[tuple[str, str, int]], text_col: str = "text") -> DataFrame:
    """Add ``agent``, ``agent_score`` and ``agent_confidence``: the group whose rules weigh most, if at least 5.

    Of each group at most six rules count, the heaviest that hit; ties go to the group first by name.
    """
    groups: dict[str, list[tuple[str, int]]] = {}
    for group, pattern, weight in checked(rules):
        groups.setdefault(group, []).append((pattern, weight))
    t = F.coalesce(F.col(text_col), F.lit(""))

    def total(own: list[tuple[str, int]]) -> Column:
        hits = F.sort_array(F.array_compact(F.array(*[F.when(found(t, p, "i"), w) for p, w in own])), asc=False)
        return F.aggregate(F.slice(hits, 1, AGENT_RULES), F.lit(0), lambda a, w: a + w)

    scores = F.array_sort(
        F.array(*[F.struct(F.lit(g).alias("agent"), total(own).alias("score")) for g, own in sorted(groups.items())]),
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["agent"] < b["agent"], -1).otherwise(1),
    )
    d = df.withColumn("__s", scores)
    top, second = F.col("__s")[0], F.when(F.size("__s") > 1, F.col("__s")[1]["score"]).otherwise(0)
    sure = F.least(F.lit(AGENT_MOST), 0.5 * (top["score"] - second) / top["score"] + 0.5 * F.least(F.lit(1.0), top["score"] / AGENT_FULL))
    hit = top["score"] >= AGENT_LEAST
    return d.select(*df.columns, F.when(hit, top["agent"]).alias("agent"), F.when(hit, top["score"]).otherwise(0).cast("bigint").alias("agent_score"), F.when(hit, F.floor(sure * 100 + 0.5) / 100).otherwise(0.0).alias("agent_confidence"))


def coherence(df: DataFrame, fingerprints: DataFrame, id_col: str = "doc_id", text_col: str = "text", cwes: str = "cwes") -> DataFrame:
    """Mean agreement of a text with the CWEs it claims: (id, coherence, swapped, underspecified).

    ``fingerprints`` has (cwe, required, expected, negative, min_density, rejection), the
    first three arrays of phrases. Unknown CWEs count 50; rows without CWEs have no row.
    """
    claims = df.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.explode(F.array_distinct(cwes)).alias("cwe"))
    j = claims.join(fingerprints, "cwe", "left")
    hits = lambda c: F.size(F.filter(c, lambda p: F.col("t").contains(p)))
    words = F.greatest(F.size(F.split(F.trim("t"), r"\s+")), F.lit(1))
    required = F.when((F.size("required") == 0) | (hits("required") > 0), 100.0).otherwise(0.0)
    expected = F.when(F.size("expected") > 0, 100.0 * hits("expected") / F.size("expected")).otherwise(50.0)
    negative = F.least(F.lit(80.0), 15.0 * hits("negative"))
    density = clamp(100.0 * (hits("required") + hits("expected")) / words / (F.col("min_density") / 10))
    prior = F.when(F.col("rejection") > 1.5, 100.0 / F.col("rejection")).otherwise(100.0)
    raw = clamp(0.15 * required + 0.40 * expected - 0.20 * negative + 0.20 * density + 0.05 * prior)
    s = F.when((required == 100) & (negative == 0) & (expected >= 50), F.greatest(raw, F.lit(68.0))).otherwise(raw)
    s = F.when((expected >= 80) & (density >= 80), F.greatest(s, F.lit(78.0))).otherwise(s)
    s = F.when((required == 0) & (negative >= 30), F.least(s, F.lit(25.0))).otherwise(s)
    each = j.select(id_col, F.when(F.col("required").isNull(), 50.0).otherwise(s).alias("s"))
    g = each.groupBy(id_col).agg(js_round(F.avg("s")).alias("coherence"), F.max(F.col("s") < 30).alias("swapped"), F.max((F.col("s") >= 30) & (F.col("s") < 50)).alias("underspecified"))
    return g


def family(df: DataFrame, members: DataFrame, closure: DataFrame, keywords: Sequence[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", cwes: str = "cwes", flat: str = "FLAT") -> DataFrame:
    """Family of each row with its confidence: a claimed CWE's own (HIGH), an ancestor's (MEDIUM), by keywords (MEDIUM from three, else LOW), else ``flat``.

    ``members`` has (cwe, family), ``closure`` (cwe, ancestor, distance). Nearer ancestors, then the name, decide.
    """
    c = df.select(id_col, F.explode(cwes).alias("cwe")).distinct()
    own = c.join(members, "cwe").groupBy(id_col).agg(F.min("family").alias("own"))
    far = c.join(closure, "cwe").join(members.withColumnRenamed("cwe", "ancestor"), "ancestor").groupBy(id_col).agg(F.min(F.struct("distance", "family")).alias("far"))
    groups: dict[str, list[str]] = {}
    for g, k in keywords:
        groups.setdefault(g, []).append(k)
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    hits = F.array(*[F.struct(sum((F.when(low.contains(k), 1).otherwise(0) for k in ks), F.lit(0)).alias("n"), F.lit(g).alias("g")) for g, ks in sorted(groups.items(), reverse=True)])
    best = F.array_max(hits)
    j = df.select(id_col, best.alias("k")).join(own, id_col, "left").join(far, id_col, "left")
    kn = F.col("k.n")
    return j.select(
        id_col, F.coalesce("own", F.col("far.family"), F.when(kn > 0, F.col("k.g")), F.lit(flat)).alias("family"),
        F.when(F.col("own").isNotNull(), "HIGH").when(F.col("far").isNotNull() | (kn >= 3), "MEDIUM").when(kn > 0, "LOW").otherwise("LOW").alias("confidence"),
    )


def questions(rules: Sequence[tuple[Column, str]], most: int = 4) -> Column:
    """The texts of the rules that hold, in order, at most ``most`` (the report's length)."""
    return F.slice(F.array_compact(F.array(*[F.when(c, text) for c, text in rules])), 1, most)


def technology(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Name with the most matches; ties to the first listed; null without any."""
    counts = F.array(*[F.struct(count(text, p, "i").alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(patterns)])
    return F.when(F.array_max(counts)["n"] > 0, F.array_max(counts)["name"])

