"""References of texts looked up in supplied tables: files and functions of a named repository, and CVEs.

A text gives at most five names of code and three CVEs (the definition), one row
each. Rows meet the tables by key; a reference that very many texts share is
looked up by broadcast, of which there are at most 500, all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reference_rules as R
from ..functions.text import every, js_round, let
from ..sources.work import settled
from .advice import code_references, projects

#: A key with more than this share of all rows is looked up by broadcast.
HEAVY_SHARE = 1 / 500


def edges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, place, kind, repo, target): what each text refers to. Names of code need a repository."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(id_col, t.alias("t")).select(id_col, code_references(F.col("t")).alias("c"), F.filter(projects(F.col("t")), lambda p: p["slug"].contains("/")).alias("p"), F.array_distinct(every(F.col("t"), *R.CVE)).alias("v"))
    repo = F.get(F.col("p"), F.lit(0))["slug"]
    item = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("target"))
    code = F.slice(F.concat(F.transform("c.paths", item("file")), F.transform("c.functions", item("function"))), 1, R.MOST_CODE)
    cves = F.transform(F.slice("v", 1, R.MOST_CVES), item("cve"))
    d = d.select(id_col, repo.alias("repo"), F.posexplode(F.concat(F.when(repo.isNotNull(), code).otherwise(F.slice(code, 1, 0)), cves)).alias("place", "r"))
    return d.select(id_col, "place", "r.kind", F.when(F.col("r.kind") != "cve", F.col("repo")).otherwise("").alias("repo"), "r.target")


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``known`` (one row per key), null where it has none."""
    limit = max(1000, int(rows.count() * HEAVY_SHARE))
    wanted = rows.groupBy(*keys).agg(F.count("*").alias("__rows")).join(known, keys)
    heavy, light = wanted.where(F.col("__rows") > limit), wanted.where(F.col("__rows") <= limit)
    many = rows.join(F.broadcast(heavy.drop("__rows")), keys)
    return many.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.drop("__rows"), keys, "left"))


def _phrases(text: Column) -> Column:
    """Phrases of four longer words, as often as a text has them. Words are split once: a lambda that named the expression would split them anew for each phrase."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")), r"\s+"), lambda w: F.length(w) > R.SHORT_WORD)
    of = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (R.PHRASE - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(R.PHRASE)), " "))
    return let(words, lambda w: F.when(F.size(w) >= R.PHRASE, of(w)).otherwise(F.array().cast("array<string>")))


def _share(said: Column, description: Column) -> Column:
    def share(known: Column) -> Column:
        hits = F.size(F.filter(said, lambda s: F.array_contains(known, s)))
        return F.when(F.size(known) > 0, js_round(100.0 * hits / F.size(known))).otherwise(0)

    return F.when(F.length(F.coalesce(description, F.lit(""))) < R.SHORT_DESCRIPTION, 0).otherwise(let(F.array_distinct(_phrases(description)), share)).cast("bigint")


def overlap(text: Column, description: Column) -> Column:
    """How much of a description's phrases of four longer words a text has, in hundredths (a phrase counts as often as the text has it)."""
    return let(_phrases(text), lambda said: _share(said, description))


def verify(df: DataFrame, files: DataFrame, functions: DataFrame, cves: DataFrame, year: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, checks): for each text with references an array of (type, target, weight) in order, as :func:`.triage.verification` takes them.

    ``files`` and ``functions`` have (repo, target), ``cves`` (target, description); ``year`` is the current one; ids are
    unique. What texts refer to is extracted once and kept in the shared folder, as the look-up reads it several times.
    """
    code = files.select("repo", "target").distinct().withColumn("kind", F.lit("file")).unionByName(functions.select("repo", "target").distinct().withColumn("kind", F.lit("function"))).withColumn("description", F.lit(None).cast("string"))
    known = code.unionByName(cves.groupBy("target").agg(F.max("description").alias("description")).select(F.lit("").alias("repo"), "target", F.lit("cve").alias("kind"), "description")).withColumn("found", F.lit(True))
    got = looked_up(settled(edges(df, id_col, text_col)), known, ["kind", "repo", "target"])
    per_text = got.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "kind", "target", F.coalesce("found", F.lit(False)).alias("found"), "description"))).alias("refs"))  # eight a text
    text = df.select(id_col, F.col(text_col).alias("__t"))

    def check(r: Column, said: Column) -> Column:
        of = F.regexp_extract(r["target"], R.CVE[0], 1).try_cast("int")
        age = F.lit(year) - of
        name = F.when(r["kind"] == "file", F.when(r["found"], "file_verified").otherwise("file_missing")).when(r["kind"] == "function", F.when(r["found"], "function_verified").otherwise("function_missing"))
        name = name.when((of > year + 1) | (of < R.FIRST_YEAR), "invalid_cve_year").when(~r["found"] & (age > 2), "fabricated_cve").when(~r["found"] & (age > 1), "stale_missing_cve").when(~r["found"], "recent_cve_not_yet_published")
        name = name.when(_share(said, r["description"]) > R.COPIED, "plagiarism").otherwise("verified_cve")
        weights = F.create_map(*[F.lit(x) for item in R.WEIGHTS.items() for x in item])
        return let(name, lambda n: F.struct(n.alias("type"), r["target"].alias("target"), F.element_at(weights, n).cast("bigint").alias("weight")))

    described = F.exists("refs", lambda r: r["description"].isNotNull())
    checks = let(F.when(described, _phrases(F.col("__t"))), lambda said: F.transform("refs", lambda r: check(r, said)))
    return per_text.join(text, id_col).select(id_col, checks.alias("checks"))
