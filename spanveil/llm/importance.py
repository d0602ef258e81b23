"""Importance resampling towards a target: hashed features, bucket gains, Gumbel keys, the top share of documents.

Words are runs of digits, a-z (A-Z lower-cased) and all characters beyond ASCII; features are all runs of 1 to
``n`` words, repeats counted, in the bucket of their crc32. A bucket gains what its share among the target's
features is larger than among the documents' (add-one, in thousandths of the natural logarithm); a document weighs
the sum over its features. Adding Gumbel noise, seeded by the document's id, and taking the highest keys draws without
replacement in proportion to the weights.

Long texts are skewed work: one of over ``chunk_bytes`` is split at word boundaries into chunks that are dealt to all
tasks. A chunk carries the n-1 words after its end and owns the features that start before it, so chunks' counts and
weights sum to the document's. The chunks' buckets are staged, two or four bytes a feature; texts are cut into words once.

A null or empty text has no features: weight 0. A null id has no key: it counts among the documents' features, but takes
no part in the draw, and its score and rank are null. Repeated rows of one id and text are documents of their own with
equal numbers. Only the id and the text of the input are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import before_parts, documents, in_ranges, lean, staged

#: Bytes of words as they count, all others as blanks.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
ONE_WORD = re.compile(rb" *[^ ]+")
CHUNKS = "id long, row_key long, chunk int, n_words long, n_features long, buckets binary"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def chunks_of(text: bytes, most: int, n: int) -> Iterator[tuple[bytes, bytes]]:
    """(own, carried): own parts cover the text and end between words; carried holds the n-1 words that follow, or what is left."""
    text, lo = text.translate(WORD_BYTES), 0
    while lo < len(text):
        hi = text.find(b" ", lo + most)
        hi = len(text) if hi < 0 else hi
        end = hi
        for _ in range(n - 1):
            end = m.end() if (m := ONE_WORD.match(text, end)) else end
        yield text[lo:hi], text[hi:end]
        lo = hi


def buckets_of(own: list[bytes], carried: list[bytes], n: int, buckets: int) -> np.ndarray:
    """Buckets of the features that start in own words."""
    found, words = [*map(crc32, own)], own + carried
    for k in range(2, n + 1):
        found += [crc32(b" ".join(words[i : i + k])) for i in range(min(len(own), len(words) - k + 1))]
    return np.array(found, np.uint32) % np.uint32(buckets)


def width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _featurise(n: int, buckets: int):
    """(id, row_key, chunk, own, carried) to CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, features, packed = [], [], []
            for own, carried in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                own = words_of(own or b"")
                found = buckets_of(own, words_of(carried or b""), n, buckets)
                sizes.append(len(own))
                features.append(len(found))
                packed.append(found.astype(width(buckets)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())], ["id", "row_key", "chunk", "n_words", "n_features", "buckets"])

    return run


def _split(n: int, most: int):
    """Long texts to rows of their chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                for k, (own, carried) in enumerate(chunks_of(text.as_py(), most, n)):
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([k], pa.int32()), pa.array([own]), pa.array([carried])], ["id", "row_key", "chunk", "own", "carried"])

    return run


def featurised(docs: DataFrame, n: int, buckets: int, chunk_bytes: int, id_col: str | None, text_col: str) -> DataFrame:
    """Chunks of all texts with their features' buckets; only long texts are split and dealt anew."""
    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(key.alias("id"), F.xxhash64(key, F.coalesce(text_col, F.lit(""))).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("own"))
    long = F.octet_length("own") > chunk_bytes
    whole = rows.filter(~long).select("id", "row_key", F.lit(0).alias("chunk"), "own", F.lit(None).cast("binary").alias("carried"))
    parts = rows.filter(long).mapInArrow(_split(n, chunk_bytes), "id long, row_key long, chunk int, own binary, carried binary")
    run = lean(_featurise(n, buckets))
    return whole.mapInArrow(run, CHUNKS).unionByName(parts.repartition("row_key", "chunk").mapInArrow(run, CHUNKS))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                counts += np.bincount(np.frombuffer(packed.as_py(), width(buckets)), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return run


def counts_of(chunks: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; a task sends at most a row for each bucket, and so much comes to the driver."""
    rows = chunks.select("buckets").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of add-one shares, rounded down."""
    own, other, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (own + size) / ((s + 1) * (other + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains.value[np.frombuffer(x.as_py(), width(buckets))].sum()) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.int64())], ["id", "row_key", "chunk", "n_words", "n_features", "weight"])

    return run


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate of the key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, chunk_bytes: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row; rank is null where a document is not drawn."""
    spark = docs.sparkSession
    chunks = staged(featurised(docs, n, buckets, chunk_bytes, id_col, text_col), "feature-buckets")
    wanted = featurised(target, n, buckets, chunk_bytes, None, target_text)
    gains = spark.sparkContext.broadcast(gains_of(counts_of(chunks, buckets), counts_of(wanted, buckets)))
    weighed = chunks.mapInArrow(lean(_weigh(gains, buckets)), "id long, row_key long, chunk int, n_words long, n_features long, weight long")
    sums = weighed.groupBy("id", "row_key").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    each = [F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")]  # equal rows have equal numbers
    rows = sums.select("id", *each, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
    scored = staged(rows.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), ((F.col("n_words") >= min_words) & F.col("id").isNotNull()).alias("open")), "scores")
    total, eligible = scored.agg(F.count(F.lit(1)), F.coalesce(F.count_if("open"), F.lit(0))).first()
    order = [F.col("open").desc(), F.col("score").desc(), F.col("id").asc()]
    ranged = in_ranges(scored, order, total, "ranked")
    ahead = before_parts({r[0]: r[1] for r in ranged.groupBy("_part").count().collect()})
    ahead = F.broadcast(spark.createDataFrame([*ahead.items()] or [(0, 0)], "_part int, _ahead long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_ahead")
    drawn = F.when(F.col("open") & (place <= percent * eligible // 100), place.cast("long"))
    return ranged.join(ahead, "_part").select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", drawn.alias("rank"))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return resample(docs, documents(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """crc32 over the bytes of each distinct word by its table of 256 remainders, which a rule gives."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
remainders AS (SELECT {table}::BIGINT[] AS t),
coded AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i - 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), remainders),
held AS (SELECT side, doc_id, bucket FROM words JOIN coded USING (w)),
counts AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM (SELECT unnest(range(10000)) AS b)
  LEFT JOIN (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM held GROUP BY bucket) k ON k.bucket = b),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored s LEFT JOIN placed USING (doc_id)
"""
