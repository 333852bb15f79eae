"""What a report lacks, what must not be missed in it, what to tell its author; the projects and the code that it names.

Native expressions over one text column: one scan, no shuffle. A null text is an
empty one. What is not stated of a row (null) makes no rule fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import advice_rules as R
from ..functions.text import count, every, found, java, let
from ..functions.triage_rules import UNKNOWN
from .triage import vuln_class


def _fired(rules) -> Column:
    """Array of those values whose test holds, in the order given."""
    return F.array_compact(F.array(*[F.when(F.expr(test), value) for value, test in rules]))


def advise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``gaps`` (category, severity; the worst first), ``areas`` to look at, ``strengths``, ``feedback`` (priority, kind, tone; the first first), ``clarity`` (0 to 100) and ``actionability``.

    Needs ``slop`` (0 to 100), ``confidence``, ``placeholders`` (how many), ``fabricated`` (whether debug output is), ``verified``
    and ``not_found`` (how many references were and were not found; null where none was looked up). Other columns pass through.
    """
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__low", F.lower("__t"))
    t, low = F.col("__t"), "__low"
    own = [c for c in df.columns if c not in ("__t", "__low")]
    given = [F.col(c) for c in ("slop", "confidence", "placeholders", "fabricated", "verified", "not_found")]
    d = df.select(
        F.struct(*own).alias("__row"), *given, *[found(t, *rule, low).alias(n) for n, rule in R.FLAGS.items()], *[count(t, *rule, low).alias(n) for n, rule in R.COUNTS.items()],
        F.size(F.split(t, r"\s+")).cast("bigint").alias("words"), (vuln_class(t, low)["name"] != UNKNOWN[0]).alias("known_class"),
    )
    by_severity = sorted(R.GAPS, key=lambda g: R.SEVERITIES.index(g[1]))
    gaps = _fired((F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity")), test) for c, s, test in by_severity)
    of = lambda s: F.size(F.filter("__gaps", lambda g: g["severity"] == s)).cast("bigint")
    d = d.select("*", gaps.alias("__gaps")).select("*", of("critical").alias("critical"), of("important").alias("important_gaps"))
    item = lambda kind, tone, priority: F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), F.lit(tone).alias("tone"))
    said = _fired((item(kind, tone, priority), test) for kind, tone, priority, test in sorted(R.FEEDBACK, key=lambda f: f[2]))
    return d.select(
        "__row.*", F.col("__gaps").alias("gaps"), _fired((F.lit(a), test) for a, test in R.AREAS).alias("areas"), _fired((F.lit(s), test) for s, test in R.STRENGTHS).alias("strengths"),
        let(said, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(item(*R.NOTHING)))).alias("feedback"), F.expr(f"CAST({R.CLARITY} AS BIGINT)").alias("clarity"), F.expr(R.ACTIONABILITY).alias("actionability"),
    )


def projects(text: Column) -> Column:
    """Array of (name, slug, source): repositories by address, known projects (by address too where a version stands near), packages; ten at most, by the definition."""
    item = lambda name, slug, source: F.struct(name.alias("name"), slug.alias("slug"), F.lit(source).alias("source"))
    slugs = lambda rule: F.array_distinct(F.transform(every(text, *rule, 1), lambda s: F.regexp_replace(s, r"\.git$", "")))
    hosted = lambda rule, source: F.transform(slugs(rule), lambda s: item(F.split(s, "/")[1], s, source))
    def named(low: Column) -> Column:
        out, seen = [], {}
        for name, slug in R.PROJECTS.items():
            word = rf"\b{name}\b"
            # what stands around the first place of the name: found by one search, not by a try at every place before it
            around = let(F.split(text, java(word, "i"), 2), lambda p: F.concat(F.right(p[0], F.lit(R.NEAR)), F.lit(name), F.left(p[1], F.lit(R.NEAR))))  # noqa: B023
            first = low.contains(name) & found(text, word, "i")
            for other in seen.get(slug, ()):
                first = first & ~found(text, rf"\b{other}\b", "i")
            seen.setdefault(slug, []).append(name)
            out.append(F.when(first, F.struct(F.lit(name).alias("name"), F.lit(slug).alias("slug"), F.when(around.rlike(java(*R.VERSION_NEAR)), "github_url").otherwise("known_project").alias("source"))))
        return F.array_compact(F.array(*out))

    packages = lambda rule, spared, source: F.transform(
        F.filter(F.array_distinct(every(text, *rule, 1)), lambda p: F.length(p).between(2, 100) & ~F.lower(p).isin(*spared)), lambda p: item(p, p, source)
    )

    def joined(hosts: Column) -> Column:
        known = F.transform(hosts, lambda h: h["slug"])
        more = F.filter(let(F.lower(text), named), lambda n: ~F.array_contains(known, n["slug"]))
        return F.slice(F.concat(hosts, more, packages(R.NPM, [""], "npm_package"), packages(R.PYPI, R.PYTHON_STDLIB, "pypi_package")), 1, R.MOST_PROJECTS)

    def once(both: Column) -> Column:
        lab = F.filter(both["lab"], lambda g: ~F.array_contains(F.transform(both["hub"], lambda h: h["slug"]), g["slug"]))
        return F.concat(both["hub"], lab)

    return let(let(F.struct(hosted(R.GITHUB, "github_url").alias("hub"), hosted(R.GITLAB, "gitlab_url").alias("lab")), once), joined)


def code_references(text: Column) -> Column:
    """Struct of ``functions`` that the text names, without common ones, and file ``paths``; each once, twenty at most by the definition."""
    names = F.array_distinct(F.filter(F.concat(*[every(text, *rule, 1) for rule in R.FUNCTIONS]), lambda f: ~F.lower(f).isin(*R.COMMON_NAMES) & (F.length(f) <= R.LONGEST_FUNCTION)))
    paths = F.array_distinct(F.filter(every(text, *R.PATHS, 1), lambda p: (F.length(p) <= R.LONGEST_PATH) & ~p.startswith("http")))
    return F.struct(F.slice(names, 1, R.MOST_NAMES).alias("functions"), F.slice(paths, 1, R.MOST_NAMES).alias("paths"))
