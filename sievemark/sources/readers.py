"""Readers of reports: text files, binary files, JSON lines, curated JSON, tables, lookup feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which a curated record may hold its text, in order, and the least length of one that is kept.
TEXT_FIELDS, LEAST_CHARS = ("text", "report_text", "body", "content"), 50
#: Largest intake of a single report.
MAX_BYTES = 5 * 1024 * 1024
EXTENSIONS = ("txt", "md")


def read_texts(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Whole text files as (path, text); other extensions and files over 5 MB are not read. Filters are on the file's metadata, before its content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select("path", F.decode("content", "UTF-8").alias("text"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, length, content, is_binary)."""
    from ..operators.redaction import is_binary

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MAX_BYTES)
    return files.select("path", "length", "content", is_binary("content").alias("is_binary"))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; malformed ones are dropped. A schema is asked for, so the files are read once."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_curated(spark: SparkSession, path: str, label_fields: Sequence[str] = ("label",)) -> DataFrame:
    """Curated records (gzip or plain JSON) as (text, label): the first of the text fields that is there, at least 50 characters."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in dict.fromkeys([*TEXT_FIELDS, *label_fields])])
    raw = spark.read.schema(schema).option("multiLine", "false").option("mode", "DROPMALFORMED").json(path)
    out = raw.select(F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in TEXT_FIELDS]).alias("text"), F.coalesce(*label_fields).alias("label"))
    return out.where(F.length("text") >= LEAST_CHARS)


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Parquet tables of a folder by name; columns and filters are pushed down by what is asked of them."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_id_feed(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Distinct identifiers of a JSON feed ({field: [ids]}), upper case: the lookup table of rejected CVE ids."""
    raw = spark.read.schema(T.StructType([T.StructField(field, T.ArrayType(T.StringType()))])).option("multiLine", "true").json(path)
    return raw.select(F.explode(field).alias("id")).select(F.upper("id").alias("id")).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows (phrase, category) from JSON."""
    return spark.read.schema("phrase string, category string").option("multiLine", "true").json(path).where(F.length(F.trim("phrase")) > 0)
