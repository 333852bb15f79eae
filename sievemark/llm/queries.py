"""Registered queries of the operators and the pipeline, each over its whole table, and their SQL.

Where an entry of :data:`ORACLE_SQL` is missing, SQL cannot express the result
(encoded images, learned scores, tokenised packing, seeded random draws); the
tests in ``tests/llm`` hold those against brute force, a round trip or held-out
labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, media, mixing, near_dedup, packing, phrases, prefix_trie, quality, repeats, secrets, toxicity, warc
from .common import crc_fold, documents


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(documents(spark, sf_dir)))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return exact_dedup.groups(docs, carry=("text_sha256",))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False))).select("doc_id", "held_out", "score", "predicted", "matches")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.scan(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratings = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    model = quality.fit(docs, ratings, grades=2)
    return quality.score(docs, model).withColumn("held_out", F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False)))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_near_dedup, op2_media_columns, op3_packing, op4_exact_dedup, op5_toxicity, op6_html_extraction, op7_secrets, op8_warc, op9_mixing, op10_quality, op11_substring_dedup, op12_prefix_trie, op13_collocations, pipeline)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": rf"""
        WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
            FROM words),
        shingles AS (SELECT doc_id, unnest(s) AS sh FROM sets),
        both_sides AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM both_sides JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
        edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
        roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
        FROM sets s JOIN roots r USING (doc_id)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
        FROM f""",
    "op11_substring_dedup": r"""
        WITH words AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, row, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13),
        named AS (SELECT doc_id, row, i, array_to_string(w[i : i + 12], ' ') AS name FROM windows),
        again AS (SELECT row, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY name) AS least FROM named) WHERE least < doc_id),
        gone AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS gone_at FROM again),
        every AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
        kept AS (SELECT e.row, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS text FROM every e ANTI JOIN gone g ON g.row = e.row AND g.gone_at = e.i GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (row)""",
    "op12_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS l FROM turns GROUP BY 1),
        bits AS (  -- every byte of the decimal id, followed by eight steps of the checksum
            SELECT conv_id, l, conv_id - conv_id % 5 AS donor,
                   list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM own),
        plans AS (
            SELECT conv_id, donor, l, xor(list_reduce(steps, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 9 AS h FROM bits),
        seqs AS (SELECT p.conv_id, list_concat(coalesce(o.l[1 : p.h], []), p.l[p.h + 1 :]) AS l FROM plans p LEFT JOIN own o ON o.conv_id = p.donor),
        nodes AS (
            SELECT l[1 : d] AS k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN len(l) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
            FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM seqs) GROUP BY 1, 2),
        childless AS (SELECT k, d FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.d = n.d + 1 AND c.k[1 : n.d] = n.k)),
        subtree AS (
            SELECT u.k[1 : e] AS k, e AS d, sum(CASE WHEN u.d > 0 THEN (u.n - 1) * octet_length(encode(u.k[u.d].text)) ELSE 0 END) AS saved, sum(u.leaf) AS leaves
            FROM (SELECT n.*, CASE WHEN c.d IS NULL THEN 0 ELSE 1 END AS leaf, unnest(range(0, n.d + 1)) AS e FROM nodes n LEFT JOIN childless c ON c.k = n.k AND c.d = n.d) u GROUP BY 1, 2)
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.k[1 : n.d] = n.k) AS n_children,
               CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM nodes n JOIN subtree s ON s.k = n.k AND s.d = n.d LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.k[1 : n.d - 1]""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        counts AS (
            SELECT lang, k, phrase, count(*) AS f
            FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3)) lengths(k) WHERE len(w) >= k)
            GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY 1),
        candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
        cuts AS (
            SELECT c.lang, c.phrase, c.k, c.a, cut, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
            JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 :], ' ')),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        covered AS (
            SELECT DISTINCT s.lang, s.phrase FROM candidates s JOIN (SELECT lang, a, array_to_string(w[i : i + 1], ' ') AS inner_phrase FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE k = 3)) t
            ON t.lang = s.lang AND t.inner_phrase = s.phrase WHERE 100 * t.a >= 50 * s.a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN covered USING (lang, phrase))
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
