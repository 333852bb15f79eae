"""Five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. :func:`run` writes each stage's result as Parquet in the shared folder and
rereads it for the next, so a lost executor repeats at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from sievemark.llm.common import mark_tables, release, table
from sievemark.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; its weights are learned from the labelled documents among them.

    A null or empty text matches nothing and stays, as does a row with a null id; repeated rows are decided alike; without
    labels the prior weights decide; an empty table stays empty; columns of any name pass through.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id.

    Null and empty texts are one group; a null id ranks below every id; of repeated rows one stays; an empty table stays
    empty; columns of any name pass through.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id.

    Null, empty and blank texts are linked with nothing and stay; a null id ranks above every id; of rows that share id and
    text one stays; an empty table stays empty; columns of any name pass through.
    """
    return near_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document; the one taken in part has its first words, and ``n_chars`` is that of the text.

    Null, empty and blank texts have no words, so nothing is taken of them; a null source is a source of its own; repeated
    rows share what is taken of them; an empty table stays empty; columns of any name pass through.
    """
    return mixing.apply(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is one piece of one token; a null id stays null; repeated rows are packed separately; an empty table
    gives an empty result; further columns are ignored.
    """
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, seeded draws and tokenised packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``; only the last one's result stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark_tables()
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=[docs])
    return docs
