"""Which of several known files lie in which folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def discover(spark: SparkSession, roots: Sequence[str], files: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """Path of each dataset, or none: of the first folder that holds one of its names, the first of them.

    Folders may be of any file system that Spark reads; one that isn't there is passed over, and so is an empty file. Only names are listed, and only
    those asked for.
    """
    out: dict[str, str | None] = dict.fromkeys(files)
    names = sorted({n for ns in files.values() for n in ns})
    if not names:
        return out
    for root in roots:
        try:
            listed = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root).select("path")
            here = {r.path.rsplit("/", 1)[-1]: r.path for r in listed.collect()}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        for key, candidates in files.items():
            if out[key] is None:
                out[key] = next((here[n] for n in candidates if n in here), None)
    return out
