"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as bytes.split() and bytes.strip() take it: 0x20 and 0x09-0x0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Continuation bytes of UTF-8; what is left without them is one byte a code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only in local mode, and only where the setting is missing, a temporary folder takes its place.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there and lost executors lose nothing.

    The table goes when the driver ends, or before that by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanveil/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    relieve(spark)
    return out


relieved = [0.0]


def relieve(spark: SparkSession, every: float = 10.0) -> None:
    """The driver gives memory back, at most every so many seconds: plans of dozens of jobs otherwise fill its whole heap,
    which the JVM returns after a full collection only."""
    if time.monotonic() - relieved[0] > every:
        give_back()
        spark._jvm.System.gc()
        relieved[0] = time.monotonic()


def delete_at_end(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_rows(spark: SparkSession, most: int = 2048) -> None:
    """From now on at most that many rows in an Arrow batch: what a worker holds at once follows from it."""
    now = int(spark.conf.get(BATCH_ROWS))
    spark.conf.set(BATCH_ROWS, str(min(now, most) if now > 0 else most))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_ROWS)
    few_rows(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for table in tables:
        fs, at = _hadoop(table.sparkSession, vars(table)["_staged_at"])
        fs.delete(at, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving memory back at its end: Spark keeps workers for later tasks, and an executor has several of them idle."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its own columns of those names (in any case), which an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_ranges(df: DataFrame, order: list[Column], rows: int, name: str, share: int = 1_000_000) -> DataFrame:
    """df dealt to ranges of its order, staged; _part numbers the ranges from the first. About share rows are in each."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // share))
    return staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)


def before_parts(amounts: dict[int, int]) -> dict[int, int]:
    """Of each range, what all ranges before it hold; one entry for each partition."""
    out, total = {}, 0
    for part in sorted(amounts):
        out[part] = total
        total += amounts[part]
    return out


class TokenHasher:
    """Words between blanks to 64-bit hashes, without a Python object for each word.

    The default blanks are ASCII white space; A-Z hash as a-z. A word's hash is a sum of random values of its
    bytes times powers of an odd number, put through a bijective finaliser.
    """

    def __init__(self, blanks: bytes = ASCII_SPACE, seed: int = 97):
        values = mix64(np.arange(256, dtype=np.uint64), seed)
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self.values, self.word = values, np.ones(256, bool)
        self.word[list(blanks)] = False
        self.powers = self._powers(64)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64))

    def hashes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts and where each starts and the last ends: all words' hashes in order, and each text's number of words."""
        return self.located(data, bounds)[:2]

    def located(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As hashes(), with each word's first byte and number of bytes."""
        word = self.word[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        begins[edges] = word[edges]
        at = np.flatnonzero(begins)
        sizes = np.diff(np.searchsorted(at, bounds))
        if not len(at):
            return np.empty(0, np.uint64), sizes, at, at
        held = np.flatnonzero(word)
        first = np.searchsorted(held, at)
        lengths = np.diff(np.append(first, len(held)))
        if lengths.max() > len(self.powers):
            self.powers = self._powers(int(lengths.max()))
        local = np.arange(len(held), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
        return mix64(np.add.reduceat(self.values[data[held]] * self.powers[local], first)), sizes, at, lengths

    def chunks(self, column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, hashes, words of each row) of runs of rows; nulls are empty."""
        column = column.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
            yield lo, hi, *self.hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
