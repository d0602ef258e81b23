"""LM scoring: a Katz backoff bigram model with Good-Turing discounts (see ``discounts`` for their cut-off), in partitioned tables.

Tables, all in the shared folder: token counts, and the n-gram counts dealt by key hash to buckets, one row a
bucket with its sorted keys and counts. A word seen after its history has its discounted share of the
history's count; all others share what the discounts left, in proportion to the model one order below, with
the backoff weight that makes every history's probabilities sum to exactly one. The recursion ends with
discounted token counts; what they leave is the probability of the one unknown token.

Counting: documents become blocks of about a million tokens, each block sums its own n-grams before anything
is shuffled, so one word pair in every document is one entry a block. Scoring: the most frequent n-grams, at
most ``heavy`` of them, are sent to all tasks and settle most tokens at once; the rest are posted to their
buckets, whose sorted keys answer them, and each document's answers are summed.

Workers hold the ``frequent`` tokens (about 40 bytes each, 2^20 at most), the heavy n-grams, bounded by their number, and
one bucket. Ids go by falling count, so all other tokens of one count are one range of ids: their probabilities are a row
a count. Their ids come from buckets of hashes, which the texts' other words are posted to, and their histories lie whole in
one bucket of n-grams, which works out their weights itself. No size of the vocabulary changes what a worker holds.
``score_by_joins`` is the same model by aggregations and joins of hashed rows; the tests compare both.

Tokens: A-Z is lower-cased, words are cut at ASCII white space, and one end token closes a text. A null text
is an empty one: only the end token. Rows with a null id are never held out. Repeated rows are each counted
and scored. Without any training token the base and the model give every text 0. Input columns named like the added
ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TokenHasher, crc_mod, discard, documents, give_back, lean, mix64, relieve, staged

END = np.uint64(0x9D5C1F3B7A2E8640)  # the hash of the end token
GT_MAX = 5
BLOCK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 21
BUCKET_TYPES = 1 << 18
BLOCK, OTHERS = "_token_block", "_other_tokens"  # columns between the two passes of encode()


def tokens_of(hasher: TokenHasher, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with each text's end token, tokens of each row)."""
    for lo, hi, words, sizes in hasher.chunks(column):
        ends = np.cumsum(sizes + 1) - 1
        hashes = np.empty(len(words) + len(sizes), np.uint64)
        inner = np.ones(len(hashes), bool)
        inner[ends] = False
        hashes[inner], hashes[ends] = words, END
        yield lo, hi, hashes, sizes + 1


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, held, size = TokenHasher(), [], 0

    def out() -> pa.RecordBatch:
        codes, keys = pd.factorize(np.concatenate([h[0] for h in held]))
        counts = np.bincount(codes, np.concatenate([h[1] for h in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(counts)], ["h", "c"])

    for batch in batches:
        for _, _, hashes, _ in tokens_of(hasher, batch.column(0)):
            codes, keys = pd.factorize(hashes)
            held.append((keys, np.bincount(codes)))
            size += len(keys)
            if size > BLOCK_TOKENS:
                yield out()
                held, size = [], 0
    if held:
        yield out()


@dataclass
class Frequent:
    """Hashes of the frequent tokens, sorted, with their ids: what each worker holds of the vocabulary."""

    hashes: np.ndarray
    ids_by_hash: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for all others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        codes, own = pd.factorize(hashes)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where(self.hashes[at] == own, self.ids_by_hash[at], -1).astype(np.int32)[codes]


@dataclass
class Vocabulary:
    """Tokens' ids go by falling count. The start of a text has the id ``len``."""

    frequent: Frequent
    class_counts: np.ndarray  # the counts that occur, falling
    class_sizes: np.ndarray  # tokens of each
    rare: DataFrame | None  # all other tokens, by bucket: hashes of each count in turn, and how many of each
    rare_ids: dict[int, np.ndarray]  # of each bucket, the first id of each count
    rare_buckets: int = 0

    def __len__(self) -> int:
        return int(self.class_sizes.sum())

    @property
    def total(self) -> int:
        return int(self.class_counts @ self.class_sizes)


class ById:
    """A value for each token id, from one for each count: a table of the frequent ids, and ranges of all others."""

    def __init__(self, values: np.ndarray, vocabulary: Vocabulary):
        self.n = len(vocabulary.frequent.hashes)
        ends = np.cumsum(vocabulary.class_sizes)
        near = int(np.searchsorted(ends, self.n, "right"))
        self.near, self.far, self.ends = np.repeat(values[:near], vocabulary.class_sizes[:near]), values[near:], ends[near:]

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.far):
            return self.near[ids]
        out, rare = np.empty(len(ids)), ids >= self.n
        out[~rare] = self.near[ids[~rare]]
        out[rare] = self.far[np.searchsorted(self.ends, ids[rare], "right")]
        return out


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Values byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values.astype(kind))
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def _from_planes(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _counts(values: np.ndarray) -> bytes:
    """Counts of any size: a letter for their width, then their planes."""
    kind = "<u4" if values.max(initial=0) < 1 << 32 else "<u8"
    return kind[2].encode() + _planes(values, kind)


def _from_counts(blob: bytes) -> np.ndarray:
    return _from_planes(blob[1:], f"<u{blob[:1].decode()}")


def _in_rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary rows of so many values each."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _encode(frequent, names: list[str]):
    """Texts to the ids of frequent tokens, -1 for others, and the others' hashes. A block is a run of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher, block = frequent.value, TokenHasher(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, hashes, sizes in tokens_of(hasher, batch.column(len(names))):
                ids, ends = known.ids(hashes), np.cumsum(sizes)
                coded = [_planes(ids[e - n : e], "<i4") for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                others = _in_rows(hashes[ids < 0], _per_row((ids < 0).astype(np.int64), sizes))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(names)], pa.array(coded, pa.binary()), others, pa.array(np.full(hi - lo, block))], [*names, "token_ids", OTHERS, BLOCK])
                block += 1

    return run


def _deal(buckets: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket that leaves each bucket's keys in theirs, and where each bucket starts and the last ends."""
    bucket = _bucket_of(keys, buckets)
    order = np.argsort(bucket.astype(np.int16 if buckets < 2**15 else np.int32), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _deal_tokens(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order, ends = _deal(buckets, h)
            sizes = np.diff(ends)
            own = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), _in_rows(h[order], sizes[own]), _in_rows(c[order], sizes[own])], ["bucket", "hashes", "counts"])

    return run


def _token_bucket(class_counts: np.ndarray):
    """class_counts: falling."""

    def run(table: pa.Table) -> pa.Table:
        h, c = (np.frombuffer(b"".join(table[x].to_pylist()), np.int64) for x in ("hashes", "counts"))
        sizes = np.array([(c == x).sum() for x in class_counts.tolist()])
        return pa.table({"bucket": table["bucket"][:1], "hashes": pa.array([h[np.lexsort((h.view("u8"), -c))].tobytes()], pa.binary()), "sizes": pa.array([sizes.astype(np.int64).tobytes()], pa.binary())})

    return run


def _ask_ids(buckets: int):
    """A block's other tokens, each once, to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            first = np.flatnonzero(np.diff(block, prepend=-1))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
                h = np.unique(np.frombuffer(b"".join(batch.column(1)[lo:hi].to_pylist()), np.int64))
                order, ends = _deal(buckets, h)
                sizes = np.diff(ends)
                own = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), block[lo])), _in_rows(h[order], sizes[own]), pa.nulls(len(own), pa.binary())], ["bucket", BLOCK, "hashes", "sizes"])

    return run


def _give_ids(first_ids: dict[int, np.ndarray]):
    """Rows come by bucket, its own tokens before the posts: each post's tokens that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            for i in range(len(batch)):
                bucket, block, hashes, sizes = (c[i].as_py() for c in batch.columns)
                h = np.frombuffer(hashes, np.int64)
                if sizes is not None:
                    n = np.frombuffer(sizes, np.int64)
                    order = np.argsort(h)
                    ids = (np.arange(len(h)) + np.repeat(first_ids[bucket] - np.cumsum(n) + n, n))[order]
                    at, held = bucket, h[order]
                elif at == bucket and len(held):
                    place = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    hit = held[place] == h
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([h[hit].tobytes()], pa.binary()), pa.array([ids[place[hit]].astype("<i4").tobytes()], pa.binary())], [BLOCK, "hashes", "ids"])

    return run


def _fill(names: list[str]):
    """A block's rows, with the ids of the other tokens that have one."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        h, ids = (np.frombuffer(b"".join(answers[x].to_pylist()), kind) for x, kind in (("hashes", np.int64), ("ids", "<i4")))
        order, coded = np.argsort(h), rows["token_ids"].to_pylist()
        h, ids = h[order], ids[order]
        for i, others in enumerate(rows[OTHERS].to_pylist()):
            if others and len(h):
                own, row = np.frombuffer(others, np.int64), _from_planes(coded[i], "<i4").copy()
                place = np.minimum(np.searchsorted(h, own), len(h) - 1)
                row[row < 0] = np.where(h[place] == own, ids[place], -1)
                coded[i] = _planes(row, "<i4")
        return pa.table([*(rows[x] for x in names), pa.array(coded, pa.binary())], [*names, "token_ids"])

    return run


def _coded(column: pa.Array, size: int, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, histories, tokens of each row) of runs of coded rows; size: of the vocabulary."""
    blobs, lo = column.to_pylist(), 0
    while lo < len(blobs):
        hi, n, held = lo, 0, []
        while hi < len(blobs) and (hi == lo or n < most):
            held.append(_from_planes(blobs[hi], "<i4"))
            n += len(held[-1])
            hi += 1
        sizes = np.array([len(x) for x in held])
        ids = np.concatenate(held).astype(np.int64)
        before = np.concatenate([[0], ids[:-1]])
        before[np.cumsum(sizes) - sizes] = size
        yield lo, hi, ids, before, sizes
        lo = hi


def discounts(count_of_counts: dict[int, int], most: int = GT_MAX) -> np.ndarray:
    """d[r] for r = 0..k: Katz's Good-Turing ratios, k being the largest cut-off, at most ``most``, for which all lie in (0, 1).

    Counts above k are taken as they are. Where not even k = 2 holds (few tokens, or no count of one), absolute
    discounting up to ``most``.
    """
    n = [count_of_counts.get(r, 0) for r in range(most + 2)]
    for k in range(most, 1, -1):  # d[1] is 0 for k = 1
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        if a < 1 and all(n[1 : k + 2]):
            d = [((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d])
    off = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return np.array([1.0, *[(r - min(0.9, max(0.1, off))) / r for r in range(1, most + 1)]])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0)


@dataclass
class Unigrams:
    """log10 probabilities of tokens by id, and of the unknown token."""

    logs: ById
    unknown: float

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Unigrams:
        if not len(vocabulary):
            return cls(ById(np.zeros(0), vocabulary), 0.0)
        few = vocabulary.class_counts <= GT_MAX + 1
        kept = discounted(vocabulary.class_counts, discounts(dict(zip(vocabulary.class_counts[few].tolist(), vocabulary.class_sizes[few].tolist(), strict=True))))
        left = vocabulary.total - kept @ vocabulary.class_sizes
        whole = vocabulary.total + (1.0 if left < 1e-9 else 0.0)
        return cls(ById(np.log10(kept / whole), vocabulary), math.log10((whole - kept @ vocabulary.class_sizes) / whole))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.view("u8")) >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _pair_order(keys: np.ndarray, size: int, frequent: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs by bucket: those of a rare history all in one, those of a frequent one or of the start in all."""
    h = keys // (size + 1)
    return _deal(buckets, np.where((h >= frequent) & (h < size), ~h, keys))


def _packed(values: np.ndarray) -> bytes:
    """Rising values as gaps."""
    return _planes(np.diff(values, prepend=values.dtype.type(0)), "<i8") if len(values) else b""


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, "<i8")) if blob else np.empty(0, np.int64)


def _count_pairs(size: int, frequent: int, buckets: int):
    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        order, ends = _pair_order(keys, size, frequent, buckets)
        for b in range(buckets):
            if ends[b] < ends[b + 1]:
                own = order[ends[b] : ends[b + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(keys[own])], pa.binary()), pa.array([_counts(counts[own])], pa.binary())], ["bucket", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, ids, before, _ in _coded(batch.column(0), size):
                held.append(before * (size + 1) + ids)
                n += len(ids)
                if n > 2 * BLOCK_TOKENS:
                    yield from out(held)
                    held, n = [], 0
        if held:
            yield from out(held)

    return run


def _merge_bucket(table: pa.Table) -> pa.Table:
    keys = np.concatenate([_unpacked(x.as_py()) for x in table["keys"]])
    counts = np.concatenate([_from_counts(x.as_py()).astype(np.int64) for x in table["counts"]])
    order = np.argsort(keys, kind="stable")  # runs that are sorted already
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.add.reduceat(counts, first)
    return pa.table({"bucket": table["bucket"][:1], "keys": pa.array([_packed(keys[first])], pa.binary()), "counts": pa.array([_counts(sums)], pa.binary())})


def _count_histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("counts").to_pylist():
            c, n = np.unique(_from_counts(blob), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], ["c", "n"])


def _sums_of(keys: np.ndarray, counts: np.ndarray, logs: ById, d: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Histories in sorted pairs, with their counts, what is kept of them, and the lower order's mass."""
    h = keys // (size + 1)
    start = np.flatnonzero(np.diff(h, prepend=-1))
    return h[start], *(np.add.reduceat(x, start) if len(h) else x for x in (counts, discounted(counts, d), 10.0 ** logs[keys % (size + 1)]))


def _rare(keys: np.ndarray, size: int, frequent: int) -> np.ndarray:
    return (keys >= frequent * (size + 1)) & (keys < size * (size + 1))


def _histories(shared, d: np.ndarray):
    """Each bucket's parts of the frequent histories' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, frequent, logs = shared.value
        for batch in batches:
            for i in range(len(batch)):
                all_keys, all_counts = _unpacked(batch.column("keys")[i].as_py()), _from_counts(batch.column("counts")[i].as_py())
                own = ~_rare(all_keys, size, frequent)
                all_keys, all_counts = all_keys[own], all_counts[own]
                for at in range(0, len(all_keys), 1 << 17):  # a history cut in two is summed later
                    parts = _sums_of(all_keys[at : at + (1 << 17)], all_counts[at : at + (1 << 17)].astype(np.int64), logs, d, size)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, parts)], ["h", "c", "kept", "lower"])

    return run


def _heavy(least: int, size: int, frequent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                counts = _from_counts(batch.column("counts")[i].as_py())
                if (counts >= least).any():
                    keys = _unpacked(batch.column("keys")[i].as_py())
                    own = np.flatnonzero((counts >= least) & ~_rare(keys, size, frequent))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(counts[own].astype(np.int64))], ["key", "c"])

    return run


@dataclass
class Model:
    """What a scoring task holds besides its bucket."""

    size: int
    frequent: int
    total: int
    base: ById  # log10 of the base probability, and of the unknown token's
    base_unknown: float
    unigrams: Unigrams
    d: np.ndarray
    log_c: np.ndarray  # by frequent history, the start last: log10 of its count (-inf: none)
    log_alpha: np.ndarray  # likewise: log10 of its backoff weight
    heavy_keys: np.ndarray
    heavy_counts: np.ndarray

    def place(self, h: np.ndarray) -> np.ndarray:
        """Where a frequent history or the start stands."""
        return np.minimum(h, self.frequent)

    def kept(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(discounted(counts, self.d))

    def lower(self, w: np.ndarray) -> np.ndarray:
        out, known = np.full(len(w), self.unigrams.unknown), w >= 0
        out[known] = self.unigrams.logs[w[known]]
        return out

    def base_of(self, w: np.ndarray) -> np.ndarray:
        out, known = np.full(len(w), self.base_unknown), w >= 0
        out[known] = self.base[w[known]]
        return out

    def is_frequent(self, h: np.ndarray) -> np.ndarray:
        return (h >= 0) & ((h < self.frequent) | (h == self.size))

    def look_up_heavy(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.heavy_keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.heavy_keys, keys), len(self.heavy_keys) - 1)
        return self.heavy_keys[at] == keys, self.heavy_counts[at]


@dataclass
class Fitted:
    model: Model
    pairs: DataFrame
    buckets: int


def count_tokens(training: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, c): the training texts' token hashes and counts, written to the shared folder."""
    texts = training.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return staged(texts.mapInArrow(lean(_count_tokens), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "tokens")


def vocabulary_of(tokens: DataFrame, frequent: int = 1 << 20) -> Vocabulary:
    """Ids for all tokens: those of the largest counts, at most ``frequent``, in one table, all others in buckets."""
    counted = sorted(((r.c, r.n) for r in tokens.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most sqrt(2 total) rows
    counts, sizes = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
    far = int(np.searchsorted(np.cumsum(sizes), frequent, "right"))
    got = tokens.filter(F.col("c") > int(counts[far])).toArrow() if far < len(counts) else tokens.toArrow()
    hashes, order = got["h"].to_numpy().view("u8"), np.lexsort((got["h"].to_numpy(), -got["c"].to_numpy()))
    del got
    by_hash = np.argsort(hashes[order])
    out = Vocabulary(Frequent(hashes[order][by_hash], by_hash.astype(np.int32)), counts, sizes, None, {})
    if far < len(counts):
        buckets = max(12, -(-int(sizes[far:].sum()) // BUCKET_TYPES))
        out.rare_buckets = buckets
        dealt = tokens.filter(F.col("c") <= int(counts[far])).mapInArrow(lean(_deal_tokens(buckets)), "bucket int, hashes binary, counts binary")
        out.rare = staged(dealt.groupBy("bucket").applyInArrow(_token_bucket(counts[far:]), "bucket int, hashes binary, sizes binary"), "rare-tokens")
        at = np.cumsum(sizes)[far:] - sizes[far:]
        for r in sorted(out.rare.select("bucket", "sizes").collect()):
            out.rare_ids[r.bucket], at = at, at + np.frombuffer(r.sizes, np.int64)
    give_back()
    return out


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """docs with token_ids instead of the text, written to the shared folder: scoring reads the texts no more."""
    kept = [c for c in docs.columns if c not in (text_col, "token_ids")]
    rows = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.frequent)
    schema = lambda: docs.select(*kept).schema.add("token_ids", "binary")
    first = staged(rows.mapInArrow(lean(_encode(shared, kept)), schema().add(OTHERS, "binary").add(BLOCK, "long")), "coded")
    if vocabulary.rare is None:
        return first.select(*kept, "token_ids")
    own = vocabulary.rare.select("bucket", F.lit(None).cast("long").alias(BLOCK), "hashes", "sizes")
    posts = first.filter(F.length(OTHERS) > 0).select(BLOCK, OTHERS).mapInArrow(lean(_ask_ids(vocabulary.rare_buckets)), f"bucket int, {BLOCK} long, hashes binary, sizes binary")
    meet = own.unionByName(posts).repartition(vocabulary.rare_buckets, "bucket").sortWithinPartitions("bucket", F.col(BLOCK).asc_nulls_first())
    answers = meet.mapInArrow(lean(_give_ids(vocabulary.rare_ids)), f"{BLOCK} long, hashes binary, ids binary")
    coded = staged(first.groupBy(BLOCK).cogroup(answers.groupBy(BLOCK)).applyInArrow(_fill(kept), schema()), "coded-all")
    discard(first)
    relieve(docs.sparkSession, 0)
    return coded


def fit(coded: DataFrame, vocabulary: Vocabulary, heavy: int = 1 << 19) -> Fitted:
    """Counts, discounts and backoff weights of the coded training texts."""
    spark, size, frequent = coded.sparkSession, len(vocabulary), len(vocabulary.frequent.hashes)
    unigrams = Unigrams.of(vocabulary)
    buckets = max(12, -(-vocabulary.total // BUCKET_TOKENS))
    pairs = coded.select("token_ids").mapInArrow(lean(_count_pairs(size, frequent, buckets)), "bucket int, keys binary, counts binary")
    pairs = staged(pairs.groupBy("bucket").applyInArrow(_merge_bucket, "bucket int, keys binary, counts binary"), "pairs")
    relieve(spark, 0)  # what the pairs were dealt out by is as large as all that scoring writes
    histogram = {r.c: r.n for r in pairs.mapInArrow(lean(_count_histogram), "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}  # at most sqrt(2 total) rows
    d = discounts(histogram)

    sums = pairs.mapInArrow(lean(_histories(spark.sparkContext.broadcast((size, frequent, unigrams.logs)), d)), "h long, c long, kept double, lower double")
    sums = sums.groupBy("h").agg(*[F.sum(x).alias(x) for x in ("c", "kept", "lower")])
    whole = F.when(F.col("c") - F.col("kept") < 1e-9, F.col("c") + 1.0).otherwise(F.col("c"))
    alpha = (whole - F.col("kept")) / whole / F.greatest(1 - F.col("lower"), F.lit(1e-12))
    got = sums.select("h", F.log10(whole).alias("log_c"), F.log10(alpha).alias("log_alpha")).toArrow()
    log_c, log_alpha = np.full(frequent + 1, -np.inf), np.zeros(frequent + 1)
    place = np.minimum(got["h"].to_numpy(), frequent)
    log_c[place], log_alpha[place] = got["log_c"].to_numpy(), got["log_alpha"].to_numpy()

    least, held = max(histogram, default=0) + 1, 0
    for c in sorted(histogram, reverse=True):
        if held + histogram[c] > heavy:
            break
        least, held = c, held + histogram[c]
    got = pairs.mapInArrow(lean(_heavy(least, size, frequent)), "key long, c long").toArrow()
    order = np.argsort(got["key"].to_numpy())
    heavy_keys, heavy_counts = got["key"].to_numpy()[order], got["c"].to_numpy()[order]
    del got, order
    give_back()
    whole = vocabulary.total + size + 1
    base = ById(np.log10((vocabulary.class_counts + 1.0) / whole), vocabulary)
    return Fitted(Model(size, frequent, vocabulary.total, base, -math.log10(whole), unigrams, d, log_c, log_alpha, heavy_keys, heavy_counts), pairs, buckets)


def _per_row(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(sizes) - sizes)


def _first_scores(model, names: list[str]):
    """Everything but what the buckets know: pairs that are not heavy count as unseen for now, and rare histories as unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, w, h, sizes in _coded(batch.column(len(names)), m.size):
                known, logs, own = w >= 0, m.lower(w), np.flatnonzero(m.is_frequent(h))
                logs[own] += m.log_alpha[m.place(h[own])]
                own = own[known[own]]
                keys = h[own] * (m.size + 1) + w[own]
                heavy, counts = m.look_up_heavy(keys)
                logs[own[heavy]] = m.kept(counts[heavy]) - m.log_c[m.place(h[own[heavy]])]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(names)], pa.array(sizes.astype(np.int64)), pa.array(_per_row(known.astype(np.int64), sizes)), pa.array(_per_row(m.base_of(w), sizes)), pa.array(_per_row(logs, sizes))], [*names, "n_tokens", "n_known", "base_score", "first"])

    return run


def _post(model, buckets: int):
    """Pairs that are not heavy, and all of rare histories, to their buckets: sorted keys, and the row of each. A block's
    row keys go once, to any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            row_keys = batch.column(0).to_numpy()
            for lo, hi, w, h, sizes in _coded(batch.column(1), m.size, 1 << 20):
                row = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes)
                near = m.is_frequent(h)
                near[near] = np.isfinite(m.log_c[m.place(h[near])])
                ask = np.flatnonzero(near & (w >= 0) | (h >= m.frequent) & (h < m.size))
                keys, row = h[ask] * (m.size + 1) + np.where(w[ask] < 0, m.size, w[ask]), row[ask]  # the start follows nothing
                rest = np.flatnonzero(~m.look_up_heavy(keys)[0])
                order = rest[np.argsort(keys[rest], kind="stable")]
                keys, row = keys[order], row[order]
                order, ends = _pair_order(keys, m.size, m.frequent, buckets)
                own = [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]
                if own:
                    rows = row_keys[lo:hi].astype("<i8").tobytes()
                    block = xxhash.xxh3_64_intdigest(rows) - 2**63
                    columns = [[b for b, _ in own], [1] * len(own), [_packed(keys[x]) for _, x in own], [_planes(row[x], "<u4") for _, x in own]]
                    columns = [[*c, x] for c, x in zip(columns, (block % buckets, 2, rows, b""), strict=True)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:2], (pa.int32(), pa.int32())), *map(pa.array, columns[2:], (pa.binary(), pa.binary())), pa.array([block] * (len(own) + 1))], ["bucket", "kind", "keys", "counts", "block"])

    return run


def _answer(model):
    """Rows come by bucket, its counts before the posts: what each row gains over its first score; row keys pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = model.value, None
        size = m.size + 1
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([x[0]]), *(pa.array([y], pa.binary()) for y in x[1:])], ["block", "row_keys", "rows", "gains"])
        for batch in batches:
            for i in range(len(batch)):
                bucket, kind, keys, other, block = (c[i].as_py() for c in batch.columns)
                if kind == 2:
                    yield row(block, keys, None, None)
                    continue
                keys = _unpacked(keys)
                if kind == 0:
                    at, held, counts = bucket, keys, _from_counts(other).astype(np.int64)
                    own = _rare(held, m.size, m.frequent)
                    rare, c, kept, lower = _sums_of(held[own], counts[own], m.unigrams.logs, m.d, m.size)
                    whole = np.where(c - kept < 1e-9, c + 1.0, c)
                    log_c, log_alpha = np.log10(whole), np.log10((whole - kept) / whole / np.maximum(1 - lower, 1e-12))
                elif at == bucket and len(held):
                    place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
                    hit, h, w = held[place] == keys, keys // size, keys % size
                    seen, far = m.kept(counts[place]), _rare(keys, m.size, m.frequent)
                    gain = np.zeros(len(keys))
                    own = np.flatnonzero(hit & ~far)
                    gain[own] = seen[own] - m.log_c[m.place(h[own])] - m.unigrams.logs[w[own]] - m.log_alpha[m.place(h[own])]
                    if len(rare):
                        own = np.flatnonzero(far)
                        of = np.minimum(np.searchsorted(rare, h[own]), len(rare) - 1)
                        own, of = own[rare[of] == h[own]], of[rare[of] == h[own]]
                        gain[own] = log_alpha[of]
                        own, of = own[hit[own]], of[hit[own]]
                        gain[own] = seen[own] - log_c[of] - m.unigrams.logs[w[own]]
                    sums = np.bincount(_from_planes(other, "<u4"), gain)
                    if (rows := np.flatnonzero(sums)).size:
                        yield row(block, None, _planes(np.diff(rows, prepend=0), "<u4"), sums[rows].tobytes())

    return run


def _sum_block(table: pa.Table) -> pa.Table:
    """What all buckets say of a block of rows; a block posts at most once to each bucket."""
    keys = np.frombuffer(next(x for x in table["row_keys"].to_pylist() if x is not None), "<i8")
    total = np.zeros(len(keys))
    for rows, gains in zip(table["rows"].to_pylist(), table["gains"].to_pylist(), strict=True):
        if rows is not None:
            total[np.cumsum(_from_planes(rows, "<u4"), dtype=np.int64)] += np.frombuffer(gains)
    return pa.table({"row_key": pa.array(keys), "gain": pa.array(total)})


def score(coded: DataFrame, fitted: Fitted, id_col: str = "doc_id") -> DataFrame:
    """coded's columns but the ids, with n_tokens, n_known, train_tokens, base_score and score."""
    model = coded.sparkSession.sparkContext.broadcast(fitted.model)
    row_key = F.xxhash64(F.col(id_col), "token_ids").alias("row_key")
    kept = [c for c in coded.columns if c not in ("token_ids", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    schema = coded.select(*kept, row_key).schema
    first = coded.select(*kept, row_key, "token_ids").mapInArrow(lean(_first_scores(model, [*kept, "row_key"])), schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("first", "double"))

    posts = coded.select(row_key, "token_ids").mapInArrow(lean(_post(model, fitted.buckets)), "bucket int, kind int, keys binary, counts binary, block long")
    table = fitted.pairs.select("bucket", F.lit(0).alias("kind"), "keys", "counts", F.lit(None).cast("long").alias("block"))
    meet = table.unionByName(posts).repartition(fitted.buckets, "bucket").sortWithinPartitions("bucket", "kind")
    answers = meet.mapInArrow(lean(_answer(model)), "block long, row_keys binary, rows binary, gains binary")
    gains = answers.groupBy("block").applyInArrow(_sum_block, "row_key long, gain double").groupBy("row_key").agg(F.sum("gain").alias("gain"))
    same = coded.select(row_key).groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))  # repeated rows post alike
    gains = same.join(gains, "row_key", "left")
    out = first.join(gains, "row_key", "left").withColumn("score", F.col("first") + F.coalesce(F.col("gain") / F.col("copies"), F.lit(0.0)))
    return out.select(*kept, "n_tokens", "n_known", F.lit(fitted.model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _hashed_pairs(names: list[str]):
    """A row for each distinct (history, token) of a text; the start of a text is the history 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenHasher()
        for batch in batches:
            for lo, hi, w, sizes in tokens_of(hasher, batch.column(len(names))):
                h = np.concatenate([[np.uint64(0)], w[:-1]])
                h[np.cumsum(sizes) - sizes] = 0
                row = np.repeat(np.arange(hi - lo), sizes)
                order = np.lexsort((w, h, row))
                row, h, w = row[order], h[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
                part = batch.select(names).slice(lo, hi - lo).take(pa.array(row[first]))  # never the text, once a pair
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h[first].view("i8")), pa.array(w[first].view("i8")), pa.array(np.diff(np.append(first, len(row))))], [*names, "h", "w", "k"])

    return run


def _kept_sql(c: str, d: np.ndarray) -> Column:
    ratio = F.lit(1.0)
    for r in range(1, len(d)):
        ratio = F.when(F.col(c) == r, float(d[r])).otherwise(ratio)
    return ratio * F.col(c)


def _discounts_of(table: DataFrame, c: str = "c") -> np.ndarray:
    return discounts({r[0]: r[1] for r in table.filter(F.col(c) <= GT_MAX + 1).groupBy(c).count().collect()})


def score_by_joins(docs: DataFrame, tokens: DataFrame, train: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The same scores for any vocabulary: docs has a boolean column train. Hot words are split by Spark's skew join."""
    kept = [c for c in docs.columns if c not in (text_col, train)]
    keyed = docs.select(*kept, F.col(train).alias("_train"), F.xxhash64(F.col(id_col), F.coalesce(text_col, F.lit(""))).alias("row_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    copies = keyed.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies"))
    pairs = staged(keyed.select("row_key", "_train", "text").mapInArrow(lean(_hashed_pairs(["row_key", "_train"])), "row_key long, _train boolean, h long, w long, k long"), "hashed-pairs")
    total, size = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    one = _kept_sql("c", _discounts_of(tokens)).alias("kept")
    kept_all = tokens.select(one).agg(F.coalesce(F.sum("kept"), F.lit(0.0))).first()[0]
    whole = total + (1.0 if total - kept_all < 1e-9 else 0.0)
    unknown = math.log10((whole - kept_all) / whole) if total else 0.0
    unigrams = staged(tokens.select(F.col("h").alias("w"), F.col("c").alias("c_w"), F.log10(_kept_sql("c", _discounts_of(tokens)) / max(whole, 1.0)).alias("log_w")), "unigrams")
    seen = staged(pairs.filter("_train").groupBy("h", "w").agg(F.sum("k").alias("c")), "bigrams")
    kept_two = _kept_sql("c", _discounts_of(seen))
    sums = seen.join(unigrams, "w").groupBy("h").agg(F.sum("c").alias("c_h"), F.sum(kept_two).alias("kept"), F.sum(F.pow(F.lit(10.0), F.col("log_w"))).alias("lower"))
    bound = F.when(F.col("c_h") - F.col("kept") < 1e-9, F.col("c_h") + 1.0).otherwise(F.col("c_h"))
    histories = staged(sums.select("h", F.log10(bound).alias("log_h"), F.log10((bound - F.col("kept")) / bound / F.greatest(1 - F.col("lower"), F.lit(1e-12))).alias("log_alpha")), "histories")
    seen = seen.join(histories, "h").select("h", "w", (F.log10(kept_two) - F.col("log_h")).alias("log_seen"))
    rows = pairs.join(unigrams, "w", "left").join(histories.select("h", "log_alpha"), "h", "left").join(seen, ["h", "w"], "left")
    log_p = F.coalesce("log_seen", F.coalesce("log_alpha", F.lit(0.0)) + F.coalesce("log_w", F.lit(unknown)))
    base = F.log10((F.coalesce("c_w", F.lit(0)) + 1.0) / (total + size + 1.0))
    k = F.col("k")
    scored = rows.groupBy("row_key").agg(F.sum(k).alias("n_tokens"), F.sum(F.when(F.col("c_w").isNotNull(), k).otherwise(0)).alias("n_known"), F.sum(k * base).alias("base_score"), F.sum(k * log_p).alias("score"))
    scored = scored.join(copies, "row_key").select("row_key", *[(F.col(c) / F.col("copies")).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))])
    return keyed.drop("text", "_train").join(scored, "row_key").select(*kept, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(crc_mod(id_col, folds) == fold, F.lit(False))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", held_out().alias("held_out"), "text")
    vocabulary = vocabulary_of(count_tokens(docs.filter(~F.col("held_out"))))
    coded = encode(docs, vocabulary)
    return score(coded, fit(coded.filter(~F.col("held_out")), vocabulary))
