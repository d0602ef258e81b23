"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents.

1. Every document gives the distinct 128-bit hashes of its line keys; an aggregation with map-side
   combine counts the documents of each hash and finds the largest doc_id. Hashes in fewer than
   ``min_docs`` documents can drop nothing and stay out of the index.
2. Hashes are dealt to shards; each shard becomes one row: the bit arrays of a minimal perfect hash
   and, at the places it gives, compact arrays of fingerprints, counts and keepers.
3. The documents' hashes stream past the shard's arrays (no join of lines with lines). Shards that
   more probes than usual ask for, as with one line in a third of all documents, are handed to
   several tasks, each with its own copy of the small arrays.

Lines shorter than ``min_chars`` are never dropped. A null or empty text is one empty line. Rows with
a null id are returned untouched and count for nothing; repeated rows of one id count once and get
the same treatment. Columns of the input named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, CONTINUATION, documents, lean, mix64, staged, without

MAX_SHARDS = 4096
SHARD_KEYS = 1 << 17


def line_key(line: bytes) -> bytes:
    return line.strip(ASCII_SPACE).lower()


def _digest(line: bytes, min_chars: int) -> bytes | None:
    key = line_key(line)
    if len(key) < min_chars or len(key.translate(None, CONTINUATION)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _emit_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = {_digest(x, min_chars) for x in text.split(b"\n")} - {None}
                digests += own
                ids += [doc] * len(own)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "line_doc"])

    return run


class PerfectHash:
    """A minimal perfect hash in levels: each level's bit array holds the keys that met no other there."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.concatenate([[0], np.cumsum(counts)[:-1]]))
            at += int(counts.sum())
        self.held = at

    @staticmethod
    def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mix64(keys, level + 1) % np.uint64(words * 64)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left) and len(levels) < 48:
            words = max(1, int(np.ceil(gamma * len(left) / 64)))
            place = cls._place(left, len(levels), words)
            alone = np.bincount(place, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of every key of the set; for other keys any place or -1."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                return out
            place = self._place(keys[open_], level, len(bits))
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            found = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[found]] = (ranks[word] + below)[found]
            open_ = open_[~found]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.held + at[found]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<{len(self.levels) + 2}q", len(self.levels), len(self.rest), *map(len, self.levels))
        return head + b"".join(x.tobytes() for x in [*self.levels, self.rest])

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n, rest = struct.unpack_from("<2q", blob)
        sizes = [*struct.unpack_from(f"<{n}q", blob, 16), rest]
        words, parts = np.frombuffer(blob, "<u8", offset=16 + 8 * n), []
        for size in sizes:
            parts.append(words[:size])
            words = words[size:]
        return cls(parts[:-1], parts[-1])


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's keys to one row of arrays: half of the 128 bits is the key, the other half the fingerprint."""
    h1, h2 = pdf["h1"].to_numpy().view("u8"), pdf["h2"].to_numpy().view("u8")
    table = PerfectHash.build(h1)
    at = table.index(h1)
    if len(np.unique(at)) != len(at):
        raise ValueError("two lines share the first 64 bits of a 128-bit hash; choose another hash")
    prints, counts, keepers = np.empty(len(at), "<u8"), np.empty(len(at), "<u4"), np.empty(len(at), "<i8")
    prints[at], counts[at], keepers[at] = h2, np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF), pdf["keeper"].to_numpy()
    return pd.DataFrame({"shard": pdf["shard"][:1], "load": [int(pdf["n"].sum())], "mphf": [table.to_bytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "keepers": [keepers.tobytes()]})


SHARD_SCHEMA = "shard int, load long, mphf binary, prints binary, counts binary, keepers binary"


def _probe(min_docs: int):
    """Rows come by (shard, salt), the shard's arrays before the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, arrays = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            h1, h2, doc = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
            hits = []
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
                if lo == hi:
                    continue
                if kind[lo] == 0:
                    at = (shard[lo], salt[lo])
                    mphf, prints, counts, keepers = (batch.column(i)[int(lo)].as_py() for i in (6, 7, 8, 9))
                    arrays = PerfectHash.from_bytes(mphf), np.frombuffer(prints, "<u8"), np.frombuffer(counts, "<u4"), np.frombuffer(keepers, "<i8")
                elif at == (shard[lo], salt[lo]):
                    table, prints, counts, keepers = arrays
                    place = table.index(h1[lo:hi].view("u8"))
                    safe = np.maximum(place, 0)
                    drop = (place >= 0) & (prints[safe] == h2[lo:hi].view("u8")) & (counts[safe] >= min_docs) & (keepers[safe] != doc[lo:hi])
                    hits.append(lo + np.flatnonzero(drop))
            if hits:
                k = np.concatenate(hits)
                yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(h1[k]), pa.array(h2[k])], ["line_doc", "h1", "h2"])

    return run


def _rewrite(names: list[str], text_at: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = batch.column(text_at).cast(pa.binary()).to_pylist(), [], []
            for i, (text, gone) in enumerate(zip(texts, batch.column(len(names)).to_pylist(), strict=True)):
                lines.append((text or b"").count(b"\n") + 1)
                dropped.append(0)
                if gone and text:
                    gone = {gone[k : k + 16] for k in range(0, len(gone), 16)}
                    kept = [x for x in text.split(b"\n") if _digest(x, min_chars) not in gone]
                    dropped[-1] = lines[-1] - len(kept)
                    texts[i] = b"\n".join(kept)
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def build_index(lines: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """(h1, h2, line_doc) to one row a shard, written to the shared folder, and the number of shards."""
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("line_doc").alias("n"), F.max("line_doc").alias("keeper")).filter(F.col("n") >= min_docs)
    counted = staged(counted, "line-counts")
    shards = min(MAX_SHARDS, max(16, -(-counted.count() // SHARD_KEYS)))
    index = counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build_shard, SHARD_SCHEMA)
    return staged(index, "line-index"), shards


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with repeated lines dropped from text_col, and n_lines (before) and n_dropped added."""
    spark = docs.sparkSession
    docs = without(docs, "n_lines", "n_dropped")
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col)).dropna()
    lines = staged(texts.mapInArrow(lean(_emit_hashes(min_chars)), "h1 long, h2 long, line_doc long"), "line-hashes")
    index, shards = build_index(lines, min_docs)

    # Probes of a shard are split over as many tasks as its load asks for; the list of shards is at most MAX_SHARDS rows.
    loads = {r.shard: r.load for r in index.select("shard", "load").collect()}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, sum(loads.values()) // max(1, 2 * tasks))
    salts = [(s, max(2 * tasks // max(1, len(loads)), -(-n // share), 1)) for s, n in loads.items()]
    dealt = F.broadcast(spark.createDataFrame(salts or [(0, 1)], "shard int, salts int"))

    probes = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).join(dealt, "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("line_doc"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "line_doc", *[F.lit(None).cast("binary").alias(c) for c in ("mphf", "prints", "counts", "keepers")])
    copies = index.join(dealt, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "line_doc")], "mphf", "prints", "counts", "keepers")
    both = copies.unionByName(probes).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    hits = both.mapInArrow(lean(_probe(min_docs)), "line_doc long, h1 long, h2 long")
    gone = hits.groupBy("line_doc").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    gone = gone.mapInArrow(lean(_pack), "line_doc long, gone binary")

    names = docs.columns
    joined = docs.join(gone, docs[id_col].cast("long") == gone["line_doc"], "left").select(*[docs[c] for c in names], gone["gone"])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(lean(_rewrite(names, names.index(text_col), min_chars)), schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        both = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype("<i8")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([both[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["line_doc", "gone"])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM d),
lines AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS pos FROM parts),
keys AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND h.keeper <> k.doc_id) AS gone FROM keys k LEFT JOIN hot h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
