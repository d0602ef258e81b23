"""Model files by name, size and hash: the copy in the cache if it fits, else the source's, which then is cached."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import artifact_fits


def _found(spark: SparkSession, path: str, size: int, sha256: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "content binary")
    one = spark.read.format("binaryFile").load(path).filter(F.col("length") == size).select("content")
    return one.filter(artifact_fits("content", F.lit(size), F.lit(sha256)))


def load_artifact(spark: SparkSession, name: str, size: int, sha256: str, cache: str, source: str) -> bytes:
    """The file's bytes; a cached copy that does not fit is replaced, a source that does not fit is an error.

    A copy is written beside its place and then renamed, so no reader meets half of it.
    """
    kept = f"{cache}/{name}"
    if row := _found(spark, kept, size, sha256).first():
        return bytes(row.content)
    row = _found(spark, f"{source}/{name}", size, sha256).first()
    if row is None:
        raise ValueError(f"MODEL_DOWNLOAD_FAILED: no copy of {name} has its size and hash")
    path = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = path(f"{kept}.{uuid.uuid4().hex}.part"), path(kept)
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, False)
    out.write(row.content)
    out.close()
    fs.delete(whole, False)
    fs.rename(part, whole)
    return bytes(row.content)
