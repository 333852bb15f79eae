"""Queries of references that are looked up. Nations stand in for files of a repository, regions for its functions, parts for CVEs; texts of ours refer to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reference_rules as R
from ..functions.text import duck
from ..operators import references as rf
from ..operators import triage as tr
from . import advice_queries as aq
from .registry import query, read

_YEAR = 2026
_REPO = "acme/tool"
#: What comes before and after the names that a document's id picks.
_REFERS = "' see https://github.com/acme/tool for lib/' || lower({nation}) || '.c and src/none' || {id} % 3 || '.c, the function check_' || lower({region}) || '(a) and the function no_such_' || {id} % 2 || '(b)'"
_CVES = "' CVE-' || (2010 + {id} % 16) || '-' || (10000 + {id} % 40) || ' CVE-1990-1234 CVE-' || (2022 + {id} % 4) || '-77777 with ' || {name}"


def _tables(spark, sf_dir):
    files = read(spark, sf_dir, "nation").select(F.lit(_REPO).alias("repo"), F.concat(F.lit("lib/"), F.lower("n_name"), F.lit(".c")).alias("target"))
    functions = read(spark, sf_dir, "region").select(F.lit(_REPO).alias("repo"), F.concat(F.lit("check_"), F.lower("r_name")).alias("target"))
    part = read(spark, sf_dir, "part").where("p_partkey <= 400")
    cves = part.select(F.expr("concat('CVE-', 2010 + p_partkey % 16, '-', 10000 + p_partkey % 40)").alias("target"), F.expr("concat('the flaw in parsing of ', p_name, ' lets anyone read')").alias("description"))
    return files, functions, cves


def _texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(F.broadcast(read(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("k"), "n_name")), F.col("doc_id") % 30 == F.col("k"), "left")
    d = d.join(F.broadcast(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), "r_name")), F.col("doc_id") % 6 == F.col("r"), "left")
    refers = F.expr(_REFERS.format(nation="n_name", region="r_name", id="doc_id"))
    cves = F.expr(_CVES.format(id="doc_id", name="coalesce(concat('the flaw in parsing of ', n_name, ' lets anyone read'), '')"))
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.coalesce(refers, F.lit(""))).otherwise(""), F.when(F.col("doc_id") % 3 == 0, cves).otherwise("")).alias("text"))


_TEXT = f"""
    SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN coalesce({_REFERS.format(nation='n_name', region='r_name', id='doc_id')}, '') ELSE '' END
           || CASE WHEN doc_id % 3 = 0 THEN {_CVES.format(id='doc_id', name="coalesce('the flaw in parsing of ' || n_name || ' lets anyone read', '')")} ELSE '' END AS t
    FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 30 LEFT JOIN region ON r_regionkey = doc_id % 6"""
_WORDS = r"list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g')), '\s+'), lambda w: length(w) > 3)"
_PHRASES = "list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i : i + 3], ' '))"
_SQL = rf"""
    WITH src AS ({_TEXT}), code AS ({aq.code_sql('(SELECT * FROM src)')}), named AS ({aq.projects_sql('(SELECT * FROM src)')}),
    repos AS (SELECT doc_id, list_filter(list_transform(string_split(projects, ','), lambda p: string_split(p, '|')[2]), lambda s: contains(s, '/'))[1] AS repo FROM named),
    listed AS (
        SELECT doc_id, repo, list_concat(list_transform(list_filter(string_split(paths, ','), lambda x: x <> ''), lambda x: {{'kind': 'file', 'target': x}}), list_transform(list_filter(string_split(functions, ','), lambda x: x <> ''), lambda x: {{'kind': 'function', 'target': x}}))[1:{R.MOST_CODE}] AS r
        FROM code JOIN repos USING (doc_id)),
    refs AS (
        SELECT doc_id, repo, unnest(r).kind AS kind, unnest(r).target AS target, unnest(range(len(r))) AS place FROM listed WHERE repo IS NOT NULL
        UNION ALL SELECT doc_id, '', 'cve', unnest(v), 100 + unnest(range(len(v))) FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, {duck(R.CVE[0])})), 'ASC') AS s, regexp_extract_all(t, {duck(R.CVE[0])}) AS a,
            list_filter(regexp_extract_all(t, {duck(R.CVE[0])}), lambda x, i: list_position(regexp_extract_all(t, {duck(R.CVE[0])}), x) = i)[1:{R.MOST_CVES}] AS v FROM src)),
    known AS (
        SELECT '{_REPO}' AS repo, 'file' AS kind, 'lib/' || lower(n_name) || '.c' AS target, NULL AS description FROM nation UNION SELECT '{_REPO}', 'function', 'check_' || lower(r_name), NULL FROM region
        UNION SELECT '', 'cve', 'CVE-' || (2010 + p_partkey % 16) || '-' || (10000 + p_partkey % 40), max('the flaw in parsing of ' || p_name || ' lets anyone read') FROM part WHERE p_partkey <= 400 GROUP BY 3),
    got AS (SELECT r.*, k.target IS NOT NULL AS found, description, CAST(regexp_extract(r.target, {duck(R.CVE[0])}, 1) AS VARCHAR) AS y FROM refs r LEFT JOIN known k ON k.kind = r.kind AND k.repo = r.repo AND k.target = r.target),
    worded AS (SELECT g.*, TRY_CAST(nullif(y, '') AS INT) AS year_of, {_WORDS.format('t')} AS w, {_WORDS.format("coalesce(description, '')")} AS d FROM got g JOIN src USING (doc_id)),
    shared AS (SELECT *, list_distinct({_PHRASES.format('d')}) AS dp, CASE WHEN description IS NOT NULL THEN {_PHRASES.format('w')} ELSE [] END AS wp FROM worded),
    scored AS (SELECT *, CASE WHEN length(coalesce(description, '')) < {R.SHORT_DESCRIPTION} OR len(dp) = 0 THEN 0 ELSE floor(100.0 * len(list_filter(wp, lambda p: list_contains(dp, p))) / len(dp) + 0.5) END AS share FROM shared),
    checks AS (
        SELECT doc_id, kind, place, target, CASE WHEN kind <> 'cve' THEN kind || CASE WHEN found THEN '_verified' ELSE '_missing' END WHEN year_of > {_YEAR + 1} OR year_of < {R.FIRST_YEAR} THEN 'invalid_cve_year'
            WHEN NOT found AND {_YEAR} - year_of > 2 THEN 'fabricated_cve' WHEN NOT found AND {_YEAR} - year_of > 1 THEN 'stale_missing_cve' WHEN NOT found THEN 'recent_cve_not_yet_published' WHEN share > {R.COPIED} THEN 'plagiarism' ELSE 'verified_cve' END AS type FROM scored),
    weighed AS (SELECT *, CASE type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in R.WEIGHTS.items())} END AS weight FROM checks),
    summed AS (SELECT doc_id, string_agg(type || ' ' || target, ',' ORDER BY place) AS checks, sum(weight) AS total, count(*) FILTER (WHERE weight > 0) AS bad, count(*) FILTER (WHERE weight < 0) AS good FROM weighed GROUP BY 1)
    SELECT doc_id, checks, CAST(CASE WHEN good >= 3 AND bad = 0 THEN greatest(0, 10 - 5 * good) WHEN bad < 2 AND total > 0 THEN 40 ELSE least(100, greatest(0, 50 + total)) END AS BIGINT) AS verification FROM summed"""


@query(_SQL)
def verified_references(spark, sf_dir):
    d = rf.verify(_texts(spark, sf_dir), *_tables(spark, sf_dir), _YEAR)
    return d.select("doc_id", F.array_join(F.transform("checks", lambda c: F.concat_ws(" ", c["type"], c["target"])), ",").alias("checks"), tr.verification(F.col("checks")).alias("verification"))
