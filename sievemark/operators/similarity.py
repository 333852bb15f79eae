"""Fingerprints of texts and the searches and joins over them.

Signatures are Arrow-batched numpy functions (a fixed amount of work per word);
everything after them is joins and aggregates on keys. Searches take a query
set and compare it with all rows that share a key; nothing pairs all rows of a
group with each other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round, let, normalise, seconds, swap
from ..sources.work import settled

#: Fixed values of the signatures.
SHINGLE, HASHES, PRIME = 5, 128, 2_147_483_647
BANDS = 16
ROWS = HASHES // BANDS
SEED = "sievemark"


def coefficients(seed: str = SEED) -> tuple[np.ndarray, np.ndarray]:
    """a and b of the permutations x -> (a x + b) mod PRIME, from SHA-256 of numbered seed strings; 1 .. PRIME - 1."""
    at = lambda k, i: int.from_bytes(hashlib.sha256(f"{seed}-{k}-{i}".encode()).digest()[:4], "big") % (PRIME - 1) + 1
    return np.array([at("a", i) for i in range(HASHES)], np.int64), np.array([at("b", i) for i in range(HASHES)], np.int64)


def shingles(text: str | Column) -> Column:
    """Distinct 5-word shingles of the normalised text; the whole of it where it has fewer words."""

    def cut(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))

    return let(F.split(normalise(text), " "), cut)


def shingle_hash(shingle: Column) -> Column:
    """First four bytes of MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 8), 16, 10).cast("bigint")


def minhash(text: str | Column) -> Column:
    """128 MinHash values."""
    a, b = coefficients()

    @F.pandas_udf("array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                w = (t or "").split(" ")
                sh = {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {" ".join(w)}
                h = np.array([int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:4], "big") for x in sh], np.int64)
                low = np.full(HASHES, PRIME, np.int64)
                for at in range(0, len(h), 4096):  # a*x + b is below 2**63
                    np.minimum(low, ((a[:, None] * h[None, at : at + 4096] + b[:, None]) % PRIME).min(axis=1), out=low)
                out.append(low)
            yield pd.Series(out, dtype=object)

    return sign(normalise(text))


def buckets(signature: str | Column) -> Column:
    """16 band keys of 8 values each."""
    s = F.col(signature) if isinstance(signature, str) else signature
    band = lambda i: F.concat(F.lit("b"), i.cast("string"), F.lit(":"), F.md5(F.array_join(F.slice(s, i * ROWS + 1, ROWS), ",").cast("binary")))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)


def simhash(text: str | Column) -> Column:
    """64 votes of the words' SHA-256 bits, as one number: bit i is the vote of bit i % 8 of byte i // 8; ties are ones."""

    @F.pandas_udf("bigint")
    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, np.ndarray] = {}
        for s in batches:
            out = []
            for t in s:
                total = np.zeros(64, np.int64)
                if len(memo) > 200_000:
                    memo.clear()
                for w, n in Counter((t or "").split(" ")).items():
                    v = memo.get(w)
                    if v is None:
                        raw = hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest()[:8]
                        v = memo[w] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(np.int64) * 2 - 1
                    total += n * v
                out.append(int(np.packbits(total >= 0, bitorder="little").view("<i8")[0]))
            yield pd.Series(out, dtype="int64")

    return vote(normalise(text))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, content_hash, minhash, buckets, simhash."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    signed = df.select(F.col(id_col), F.sha2(t.cast("binary"), 256).alias("content_hash"), minhash(t).alias("minhash"), simhash(t).alias("simhash"))
    return signed.withColumn("buckets", buckets("minhash"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(HASHES))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1.0 - hamming(a, b) / 64.0


def match_class(j: Column, s: Column, shared_bucket: Column) -> Column:
    return F.when((j >= 0.8) | (shared_bucket & (j >= 0.6)), "near-duplicate").when(j >= 0.5, "high-similarity").when(s >= 0.8, "structural").otherwise("semantic")


def candidates(queries: DataFrame, corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct (query_id, match_id) that share a bucket: an equi-join on the key, no limit on candidates."""
    q = queries.select(F.col(id_col).alias("query_id"), F.explode("buckets").alias("bucket"))
    c = corpus.select(F.col(id_col).alias("match_id"), F.explode("buckets").alias("bucket"))
    return q.join(c, "bucket").where("query_id <> match_id").select("query_id", "match_id").distinct()


def similar(queries: DataFrame, corpus: DataFrame, id_col: str = "doc_id", top: int = 10, least: float = 0.15) -> DataFrame:
    """For each query the ``top`` rows of ``corpus`` most like it: query_id, match_id, similarity (0..100), match_type, rank. Ties go to the smaller id."""
    side = lambda df, k: df.select(F.col(id_col).alias(f"{k}_id"), F.col("minhash").alias(f"{k}_sig"), F.col("simhash").alias(f"{k}_sim"))
    pairs = candidates(queries, corpus, id_col).join(side(queries, "query"), "query_id").join(side(corpus, "match"), "match_id")
    scored = pairs.withColumn("j", jaccard(F.col("query_sig"), F.col("match_sig"))).withColumn("s", simhash_similarity(F.col("query_sim"), F.col("match_sim")))
    scored = scored.withColumn("combined", F.greatest("j", "s")).where(F.col("combined") >= least)
    scored = scored.select("query_id", "match_id", js_round(F.col("combined") * 100).alias("similarity"), match_class(F.col("j"), F.col("s"), F.lit(True)).alias("match_type"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def exact_lookup(df: DataFrame, hashes: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose content hash is in ``hashes`` (content_hash)."""
    keyed = df.withColumn("content_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    return keyed.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def public_match(df: DataFrame, stored: DataFrame, public: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the smallest id of the stored rows with the same text that are public, itself among them: (id, match). Rows without one are left out.

    Stored rows are one row per hash before they meet the others, so copies without number make no join rows.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("content_hash")
    held = stored.where(public).select(F.col(id_col).alias("match"), digest).groupBy("content_hash").agg(F.min("match").alias("match"))
    return df.select(id_col, digest).join(held, "content_hash").select(id_col, "match")


#: What a template hash leaves open, in this order. Fixed values.
TEMPLATE = (
    (r"CVE-\d{4}-\d{4,}", "i", "{{CVE}}"),
    (r"https?://[^\s\"'<>)}\]]+", "i", "{{URL}}"),
    (r"\b\d+\.\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9.]+)?\b", "", "{{VERSION}}"),
    (r"\b(?:CVSS[:\s]*)?[0-9]+\.[0-9]\b", "i", "{{SCORE}}"),
    (r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+){1,3}\b", "", "{{NAME}}"),
    (r"\b[0-9a-f]{7,40}\b", "i", "{{HASH}}"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "", "{{IP}}"),
)


def template_hash(text: str | Column) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")
    for pattern, flags, to in TEMPLATE:
        out = swap(out, pattern, to, flags)
    return F.sha2(normalise(out).cast("binary"), 256)


def template_reuse(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: int = 10, weight: int = 25) -> DataFrame:
    """Templates that several rows share: template_hash, uses, first_ids (the smallest ``listed`` ids), weight."""
    keyed = df.select(F.col(id_col).alias("id"), template_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("template_hash"))
    keyed = settled(keyed)  # read twice: a hash is seven replacements over a whole text
    counts = keyed.groupBy("template_hash").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("template_hash").orderBy("id")
    first = keyed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= listed).groupBy("template_hash").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return counts.where("uses > 1").join(first, "template_hash").select("template_hash", "uses", F.array_join(F.col("ids").cast("array<string>"), ",").alias("first_ids"), F.lit(weight).cast("bigint").alias("weight"))


def revisions(matches: DataFrame, scored: DataFrame, within_hours: int = 48, least: int = 70, step: int = 5) -> DataFrame:
    """Matches (query_id, match_id, similarity) whose matched row is older by less than ``within_hours``, with the change of score.

    ``scored`` has (id, score, created_at).
    """
    new = scored.select(F.col("id").alias("query_id"), F.col("score").alias("new_score"), F.col("created_at").alias("new_at"))
    old = scored.select(F.col("id").alias("match_id"), F.col("score").alias("old_score"), F.col("created_at").alias("old_at"))
    near = matches.where(F.col("similarity") >= least).join(new, "query_id").join(old, "match_id")
    gap = seconds("new_at") - seconds("old_at")
    change = F.col("new_score") - F.col("old_score")
    return near.where((gap >= 0) & (gap < within_hours * 3600)).select(
        "query_id", "match_id", "similarity", "old_score", "new_score", change.alias("score_change"),
        F.when(change <= -step, "improved").when(change >= step, "worsened").otherwise("unchanged").alias("direction"),
    )


def _long_words(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.filter(F.split(F.trim(F.regexp_replace(clean, r"\s+", " ")), " "), lambda w: F.length(w) > 3)


def _grams(words: Column, n: int = 4) -> Column:
    some = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(some(w)))


def phrase_overlap(docs: DataFrame, advisories: DataFrame, id_col: str = "doc_id", text_col: str = "text", advisory_id: str = "item_id", advisory_text: str = "text") -> DataFrame:
    """Share (in per cent) of each advisory's 4-word phrases (words over three letters) that a document repeats, repeats counted; pairs with any.

    Advisory phrases are the small side by nature, but their size is left to the
    optimiser; document phrases are counted per document before the join.
    """
    phrase = advisories.where(F.length(advisory_text) >= 20).select(F.col(advisory_id), F.array_distinct(_grams(_long_words(F.col(advisory_text)))).alias("g"))
    phrase = phrase.where(F.size("g") > 0).select(advisory_id, F.size("g").cast("bigint").alias("phrases"), F.explode("g").alias("gram"))
    held = docs.select(F.col(id_col), F.explode(_grams(_long_words(F.col(text_col)))).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("n"))
    hit = held.join(phrase, "gram").groupBy(id_col, advisory_id).agg(F.sum("n").alias("matched"), F.max("phrases").alias("phrases"))
    return hit.withColumn("overlap", js_round(F.col("matched") / F.col("phrases") * 100.0))


def typosquat(domain: str | Column, known: tuple[str, ...]) -> Column:
    """The known domain that ``domain`` imitates (its brand inside a longer label, or one or two edits away), else null."""
    d = F.lower(F.col(domain) if isinstance(domain, str) else domain)
    labels = F.split(d, r"\.")
    root = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), ".")
    embeds = lambda brand: F.exists(labels, lambda x: (x != brand) & x.contains(brand))
    own = [(d == g) | d.endswith(f".{g}") for g in known]
    tests = []
    for g in known:
        brand, stem = g.split(".")[0], ".".join(g.split(".")[:-1])
        if len(brand) >= 5:
            tests.append((embeds(brand), g))
        if len(stem) >= 4:
            far = F.levenshtein(root, F.lit(stem), 2)
            tests.append(((F.length(root) >= 4) & far.between(1, 2), g))
    hit = F.coalesce(*[F.when(t, g) for t, g in tests])
    none = own[0]
    for o in own[1:]:
        none = none | o
    return F.when(~none, hit)
