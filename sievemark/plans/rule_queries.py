"""Queries of rule scores, with rules that fit the supplied texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import d_count, d_found
from ..operators import detectors as de
from ..operators import rules as ru
from .registry import query, read

_PHRASES = (("the and", 4), ("of the", 3), ("que de", 4), ("der die", 5), ("for example", 6))
_FORMULAIC = ((r"\bthe\s+of\b", 5), (r"\bla\s+de\b", 4), (r"[.]\s+the\b", 6), (r"\bund\s+der\b", 5))
_BASE = " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in _PHRASES)
_N = " + ".join(f"CASE WHEN {d_found('text', p, 'i')} THEN 1 ELSE 0 END" for p, _ in _FORMULAIC)
_W = " + ".join(f"CASE WHEN {d_found('text', p, 'i')} THEN {w} ELSE 0 END" for p, w in _FORMULAIC)
_FACTOR = "CASE n WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 WHEN 2 THEN 1.3e0 WHEN 3 THEN 1.7e0 WHEN 4 THEN 2.2e0 ELSE 2.5e0 END"


@query(f"WITH x AS (SELECT doc_id, {_BASE} AS b, {_N} AS n, {_W} AS w FROM documents) SELECT doc_id, CAST(least(100, floor(30 * ln(1 + (b + w) * {_FACTOR}) + 0.5)) AS BIGINT) AS lexical FROM x")
def lexical_markers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ru.phrase_score(F.col("text"), _PHRASES, _FORMULAIC).alias("lexical"))


_AGENTS = (("alpha", r"\bthe\b", 3), ("alpha", r"\band\b", 3), ("alpha", r"[;:]", 2), ("beta", r"\bde\b", 4), ("beta", r"\bque\b", 4), ("gamma", r"\bder\b", 5), ("gamma", r"\bund\b", 4), ("gamma", r"ß", 2))
_SUMS = ", ".join(f"{' + '.join(f'CASE WHEN {d_found(chr(116), p, chr(105))} THEN {w} ELSE 0 END' for g, p, w in _AGENTS if g == name)} AS {name}" for name in ("alpha", "beta", "gamma"))


@query(f"""
    WITH x AS (SELECT doc_id, {_SUMS} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), y AS (SELECT *, greatest(alpha, beta, gamma) AS top, list_sort([alpha, beta, gamma], 'DESC')[2] AS second FROM x)
    SELECT doc_id, CASE WHEN top >= 5 THEN CASE top WHEN alpha THEN 'alpha' WHEN beta THEN 'beta' ELSE 'gamma' END END AS agent, CAST(CASE WHEN top >= 5 THEN top ELSE 0 END AS BIGINT) AS agent_score,
           CASE WHEN top >= 5 THEN floor(least(0.95e0, 0.5e0 * (top - second) / top + 0.5e0 * least(1e0, top / 18)) * 100 + 0.5) / 100 ELSE 0e0 END AS agent_confidence FROM y""")
def agent_stylometry(spark, sf_dir):
    return ru.stylometry(read(spark, sf_dir, "documents"), _AGENTS).select("doc_id", "agent", "agent_score", "agent_confidence")


_PRINTS = (("en", ("the", "and"), ("that", "for", "with", "thing"), ("und", "que"), 5.0, 1.2), ("de", ("der", "die"), ("und", "ein"), ("the ", " of "), 8.0, 2.0), ("fr", ("le ", "la "), ("que", "de", "et"), (), 4.0, 1.0))
_LIST = lambda ps: "[" + ", ".join(f"'{p}'" for p in ps) + "]" if ps else "CAST([] AS VARCHAR[])"
_VALUES = ", ".join(f"('{c}', {_LIST(r)}, {_LIST(e)}, {_LIST(n)}, {d}e0, {j}e0)" for c, r, e, n, d, j in _PRINTS)
_HITS = lambda c: f"len(list_filter({c}, lambda p: contains(t, p)))"


@query(f"""
    WITH f(cwe, required, expected, negative, min_density, rejection) AS (VALUES {_VALUES}),
    c AS (SELECT doc_id, lower(coalesce(text, '')) AS t, unnest(list_distinct([lang, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'xx' END])) AS cwe FROM documents),
    j AS (SELECT doc_id, f.required IS NULL AS unknown, CASE WHEN {_HITS('required')} > 0 THEN 100e0 ELSE 0e0 END AS r, 100e0 * {_HITS('expected')} / len(expected) AS e, least(80e0, 15e0 * {_HITS('negative')}) AS n,
        least(100e0, 100e0 * ({_HITS('required')} + {_HITS('expected')}) / greatest(len(regexp_split_to_array(trim(t), '\\s+')), 1) / (min_density / 10)) AS d, CASE WHEN rejection > 1.5 THEN 100e0 / rejection ELSE 100e0 END AS p FROM c LEFT JOIN f USING (cwe)),
    s1 AS (SELECT *, greatest(0e0, least(100e0, 0.15e0 * r + 0.40e0 * e - 0.20e0 * n + 0.20e0 * d + 0.05e0 * p)) AS s FROM j), s2 AS (SELECT * REPLACE (CASE WHEN r = 100 AND n = 0 AND e >= 50 THEN greatest(s, 68e0) ELSE s END AS s) FROM s1),
    s3 AS (SELECT * REPLACE (CASE WHEN e >= 80 AND d >= 80 THEN greatest(s, 78e0) ELSE s END AS s) FROM s2), s4 AS (SELECT doc_id, CASE WHEN unknown THEN 50e0 WHEN r = 0 AND n >= 30 THEN least(s, 25e0) ELSE s END AS s FROM s3)
    SELECT doc_id, CAST(floor(avg(s) + 0.5) AS BIGINT) AS coherence, bool_or(s < 30) AS swapped, bool_or(s >= 30 AND s < 50) AS underspecified FROM s4 GROUP BY 1""")
def cwe_coherence(spark, sf_dir):
    """Coherence of texts with claimed classes (languages stand in for CWE ids)."""
    prints = spark.createDataFrame([(c, list(r), list(e), list(n), d, j) for c, r, e, n, d, j in _PRINTS], "cwe string, required array<string>, expected array<string>, negative array<string>, min_density double, rejection double")
    d = read(spark, sf_dir, "documents").withColumn("cwes", F.array("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")))
    return ru.coherence(d, prints)


@query("""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS cwe, lower(text) AS t FROM documents), m(cwe, family) AS (VALUES ('en', 'GERMANIC'), ('germanic', 'GERMANIC'), ('romance', 'ROMANCE')), a(cwe, ancestor) AS (VALUES ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance')),
    k AS (SELECT doc_id, d.cwe, m.family AS own, f.family AS far, CASE WHEN contains(t, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'und') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'der') THEN 1 ELSE 0 END AS g,
              CASE WHEN contains(t, 'que') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' la ') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' de ') THEN 1 ELSE 0 END AS r
          FROM d LEFT JOIN m USING (cwe) LEFT JOIN a USING (cwe) LEFT JOIN m f ON f.cwe = a.ancestor)
    SELECT doc_id, coalesce(own, far, CASE WHEN greatest(g, r) > 0 THEN CASE WHEN r >= g THEN 'ROMANCE' ELSE 'GERMANIC' END END, 'FLAT') AS family,
           CASE WHEN own IS NOT NULL THEN 'HIGH' WHEN far IS NOT NULL OR greatest(g, r) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM k""")
def family_classification(spark, sf_dir):
    members = spark.createDataFrame([("en", "GERMANIC"), ("germanic", "GERMANIC"), ("romance", "ROMANCE")], "cwe string, family string")
    closure = de.cwe_closure(spark.createDataFrame([("de", "germanic"), ("fr", "romance"), ("es", "romance")], "cwe string, parent string"), 2)
    words = [("GERMANIC", "the"), ("GERMANIC", "und"), ("GERMANIC", "der"), ("ROMANCE", "que"), ("ROMANCE", " la "), ("ROMANCE", " de ")]
    d = read(spark, sf_dir, "documents").withColumn("cwes", F.when(F.col("doc_id") % 3 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")))
    return ru.family(d, members, closure, words)


_TECH = (("english", r"\bthe\b"), ("spanish", r"\bel\b|\blos\b"), ("french", r"\bles?\b"), ("german", r"\bd(?:er|ie|as)\b"))


@query("WITH c AS (SELECT doc_id, " + ", ".join(f"{d_count('text', p, 'i')} AS {n}" for n, p in _TECH) + " FROM documents), g AS (SELECT *, greatest(english, spanish, french, german) AS m FROM c) SELECT doc_id, CASE WHEN m = 0 THEN NULL WHEN english = m THEN 'english' WHEN spanish = m THEN 'spanish' WHEN french = m THEN 'french' ELSE 'german' END AS technology FROM g")
def technology_guess(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", ru.technology(F.col("text"), _TECH).alias("technology"))


@query("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 500 THEN 'Which steps reproduce it?' END, CASE WHEN NOT contains(text, '.') THEN 'Which version is affected?' END, CASE WHEN lang <> 'en' THEN 'Is there an English version?' END,
        CASE WHEN n_chars % 2 = 0 THEN 'Is there a trace?' END, CASE WHEN n_chars % 3 = 0 THEN 'Who else knows?' END], lambda x: x IS NOT NULL)[1:4], '|') AS questions FROM documents""")
def challenge_questions(spark, sf_dir):
    n = F.col("n_chars")
    rules = [(n < 500, "Which steps reproduce it?"), (~F.col("text").contains("."), "Which version is affected?"), (F.col("lang") != "en", "Is there an English version?"), (n % 2 == 0, "Is there a trace?"), (n % 3 == 0, "Who else knows?")]
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(ru.questions(rules), "|").alias("questions"))
