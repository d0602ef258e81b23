"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its nearest pivots in order (a prefix of its permutation of all pivots) and
posted in those pivots' inverted files. A query reads the files of its own prefix; candidates are ranked
by Spearman's footrule over the two prefixes, where a pivot missing from one stands just behind its end,
and each shard's best ones, with all that tie with the last of them, are reranked by the exact cosine in double precision.

Pivots are chosen from a bounded sample of the distinct vectors (those of the smallest content hashes), of vectors
nearly alike only one: a hot group of near copies gets hardly more pivots than a single vector, and so leaves the
others' prefixes as they are. Their number grows as the square root of the number of vectors, up to a bound; a prefix has a
share of them, up to a bound too, so that what a query reads of the files does not grow faster than the entries. Prefixes are
made once for each vector. Every vector is indexed, in shards of bounded size; the queries meet them in blocks of bounded size. Equal vectors are one entry with its ``k + 1`` smallest
ids, which is all that any answer can need: copies by the thousand cost no more than one vector.

Vectors that are null, of another length than most, zero, or that hold null or non-finite components take
no part. Rows with a null id take no part. A repeated id counts once. A table with fewer than two vectors
gives no rows. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, lean, staged


def usable(vector: Column) -> Column:
    """A vector with a cosine: no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def entries_of(table: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """Distinct vectors (entry, vector) with their keep smallest ids, entry being the smallest."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    rows = rows.withColumn("h", F.xxhash64("vector")).withColumn("g", F.xxhash64(F.lit(7), "vector"))
    first = Window.partitionBy("h", "g", "salt").orderBy("vec_id")
    within = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= keep)
    groups = within.groupBy("h", "g").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.min_by("vector", "vec_id").alias("vector"))
    return groups.select(F.element_at("ids", 1).alias("entry"), F.slice("ids", 1, keep).alias("ids"), "vector", "h")


def _place_type(n_pivots: int) -> str:
    return "<u2" if n_pivots <= 1 << 16 else "<u4"


def permutations(x: np.ndarray, pivots: np.ndarray, length: int, rows: int = 256) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    out = np.empty((len(x), length), _place_type(len(pivots)))
    for lo in range(0, len(x), rows):
        part = x[lo : lo + rows]
        near = (part / np.abs(part).max(axis=1, keepdims=True)).astype(np.float32) @ pivots.T
        top = np.argpartition(near, len(pivots) - length, axis=1)[:, len(pivots) - length :]
        out[lo : lo + rows] = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
    return out


def prefix_length(pivots: int, share: float, most: int) -> int:
    """A share of the pivots, at most ``most``: of each entry, a query's postings are length ** 2 / pivots on average."""
    return max(1, min(most, math.ceil(share * pivots)))


def pivots_of(entries: DataFrame, n: int, per_root: float, most: int, alike: float = 0.95) -> np.ndarray:
    """Unit vectors of about per_root * sqrt(n) entries, at most ``most``, from four times as many of the smallest content
    hashes: none within cosine ``alike`` of an earlier one, unless too few are left."""
    m = min(n, most, max(64, math.ceil(per_root * math.sqrt(n))))
    got = entries.orderBy("h", "entry").limit(4 * m).select("vector").toArrow().column(0).combine_chunks()
    x = got.flatten().to_numpy().reshape(len(got), -1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    apart, others, k = np.empty((m, x.shape[1])), [], 0
    for i, v in enumerate(x):
        if k == m:
            break
        if k and (apart[:k] @ v).max() >= alike:
            others.append(i)
        else:
            apart[k] = v
            k += 1
    return np.concatenate([apart[:k], x[others[: m - k]]])


class InvertedFiles:
    """One shard of the index: for each pivot, the entries that hold it in their prefix, and how far from its end."""

    def __init__(self, prefixes: np.ndarray, n_pivots: int):
        n, self.length = prefixes.shape
        pivot = prefixes.ravel()
        order = np.argsort(pivot, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(pivot, minlength=n_pivots))])
        self.bits, self.n = self.length.bit_length(), n
        self.posts = (order // self.length << self.bits) + (self.length - order % self.length)  # both in one number: one copy a list
        if n << self.bits < 1 << 31:
            self.posts = self.posts.astype(np.int32)
        self.most = np.arange(self.length, 0, -1, dtype=self.posts.dtype)

    def closeness(self, prefix: np.ndarray) -> np.ndarray:
        """A constant less half the footrule of each entry: a shared pivot takes off what its later place is from the end."""
        begin, end = self.first[prefix], self.first[prefix + 1]
        posts = np.concatenate([self.posts[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        gains = np.minimum(posts & ((1 << self.bits) - 1), np.repeat(self.most, end - begin))
        return np.bincount(posts >> self.bits, gains, self.n)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _prefixes(pivots, length: int):
    """Rows with the prefixes of their vectors, the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                own = permutations(_matrix(pa.chunked_array([batch.columns[-1]])), pivots.value, length)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in own], pa.binary())], [*batch.schema.names, "prefix"])

    return run


def with_prefixes(table: DataFrame, vector_col: str, pivots: np.ndarray, length: int, name: str) -> DataFrame:
    """table with the prefixes of its vectors, staged: a vector meets the pivots once, in however many blocks it is searched."""
    rows = table.select(*[c for c in table.columns if c != vector_col], vector_col)
    shared = table.sparkSession.sparkContext.broadcast(pivots.astype(np.float32))
    return staged(rows.mapInArrow(lean(_prefixes(shared, length)), rows.select("*").schema.add("prefix", "binary")), name)


def _from_blobs(column: pa.ChunkedArray, n_pivots: int) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), _place_type(n_pivots)).reshape(len(blobs), -1)


def _search_shard(n_pivots: int, rerank: int, k: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(shard) and len(asked):
            x, q = _matrix(shard["vector"]), _matrix(asked["q"])
            files = InvertedFiles(_from_blobs(shard["prefix"], n_pivots), n_pivots)
            norms, ids = np.sqrt(np.einsum("ij,ij->i", x, x)), shard["ids"].to_pylist()
            entry = shard["entry"].to_numpy()
            for query, vector, prefix in zip(asked["query_id"].to_pylist(), q, _from_blobs(asked["prefix"], n_pivots).astype(np.int64), strict=True):
                close = files.closeness(prefix)
                best = np.flatnonzero(close >= np.partition(close, -rerank)[-rerank]) if rerank < len(close) else np.arange(len(close))
                score = np.einsum("ij,j->i", x[best], vector) / (norms[best] * math.sqrt(vector @ vector))
                for i in np.lexsort((entry[best], -score))[: k + 1]:
                    own = [v for v in ids[best[i]] if v != query]
                    out["query_id"] += [query] * len(own)
                    out["vec_id"] += own
                    out["score"] += [float(score[i])] * len(own)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def search(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", per_root: float = 28.0, most_pivots: int = 1 << 13, prefix_share: float = 0.1, most_prefix: int = 128, rerank: int = 256, shard_entries: int = 8192, block_queries: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by cosine.

    queries: a condition on id_col. prefix_share, most_prefix: length of a prefix as a share of the pivots, and at most.
    rerank: how many entries of each shard, those tied with the last included, get an exact cosine with a query.
    """
    empty = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = table.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    clean = clean.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    clean = clean.filter(F.size("vector") == common.d)
    entries = staged(entries_of(clean, "vec_id", "vector", k + 1), "vectors")
    n = entries.count()
    pivots = pivots_of(entries, n, per_root, most_pivots)
    length = prefix_length(len(pivots), prefix_share, most_prefix)
    entries = with_prefixes(entries.select("entry", "ids", "vector"), "vector", pivots, length, "prefixes")

    asked = clean.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")).dropDuplicates(["query_id"])
    asked = with_prefixes(asked, "q", pivots, length, "queries")
    # The index goes to each block of queries. Few shards are dealt to some blocks more, or they would leave cores idle.
    shards = -(-n // shard_entries)
    spread = min(4, -(-int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    blocks = max(spread, -(-asked.count() // block_queries))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    index = entries.select(F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "entry", "ids", "vector", "prefix")
    reading = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "q", "prefix")
    found = index.groupBy("shard", "block").cogroup(reading.groupBy("shard", "block")).applyInArrow(_search_shard(len(pivots), rerank, k), "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
