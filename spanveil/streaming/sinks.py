"""Sinks that survive a repeated batch and a half-written file.

A ledger keeps, as Parquet partitions by batch, which requests a batch was the first to send. A repeated batch writes
its own partition again with the same rows and sends only what no other batch has; receivers see a request's key and take
it once. Settings are folders of versions; a version counts once its mark is there, which is the last thing written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


class Ledger:
    """For foreachBatch: send(rows) is called with rows that no batch has sent, and again if it failed before its end."""

    def __init__(self, path: str, send: Callable[[DataFrame], None], key: str = "request"):
        self.path, self.send, self.key = path, send, key

    def sent(self, spark: SparkSession) -> DataFrame | None:
        """(key, batch) of all that is sent or being sent."""
        return spark.read.parquet(f"{self.path}/rows") if _exists(spark, f"{self.path}/rows") else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{self.path}/done/{number}"
        if _exists(spark, done):
            return
        new = batch.dropDuplicates([self.key])
        if (before := self.sent(spark)) is not None:
            new = new.join(before.filter(F.col("batch") != number).select(self.key), self.key, "left_anti")
        own = f"{self.path}/rows/batch={number}"
        new.select(self.key).write.mode("overwrite").parquet(own)
        self.send(new.join(spark.read.parquet(own), self.key, "left_semi"))
        fs, at = _hadoop(spark, done)
        fs.create(at, True).close()


def save_settings(settings: DataFrame, path: str) -> int:
    """settings as the next version at path; the mark is written when all of it is there."""
    spark = settings.sparkSession
    number = max([0, *_versions(spark, path, marked=False)]) + 1
    own = f"{path}/{number:09d}"
    settings.write.parquet(f"{own}/rows-{uuid.uuid4().hex}")
    fs, at = _hadoop(spark, f"{own}/_DONE")
    fs.create(at, False).close()
    return number


def _versions(spark: SparkSession, path: str, marked: bool) -> list[int]:
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    return [int(n) for n in names if n.isdigit() and (not marked or _exists(spark, f"{path}/{n}/_DONE"))]


def load_settings(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version with its mark; None before the first."""
    found = _versions(spark, path, marked=True)
    if not found:
        return None
    own = f"{path}/{max(found):09d}"
    fs, at = _hadoop(spark, own)
    rows = [x.getPath().toString() for x in fs.listStatus(at) if x.getPath().getName().startswith("rows-")]
    return spark.read.parquet(*rows)
