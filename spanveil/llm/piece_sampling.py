"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's lattice has a node for every code point and an edge for every vocabulary piece. The forward pass
sums, at each node, the weights of all segmentations that end there; the backward pass draws from the end,
each step an edge in proportion to its share of the sum. So a whole segmentation comes out with exactly
its share of the total weight. Random numbers are a hash of (seed, row key, part, step), hence the same row
always gets the same pieces, however the table is partitioned or a task is repeated.

The vocabulary is a merge list, whose scores are ranks: rank r weighs (r + 1) ** -theta (Zipf's law).
Code points without a piece become byte pieces.

A leading space is added before encoding and taken off in decoding, as the usual decoders do. The
sign that stands for a space inside vocabularies is, when a text holds it, spelled in bytes, so that
decoding is lossless for every text. A null text has null pieces, an empty one none. A null key counts as
the text "null"; repeated rows get the same pieces. Input columns named like the added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, lean, mix64, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Vocabulary:
    """Pieces with their log weights, as a value that ships to executors."""

    def __init__(self, pieces: dict[str, tuple[int, float]], spelled: list[bytes], byte_ids: list[int], longest: int):
        self.pieces, self.spelled, self.byte_ids, self.longest = pieces, spelled, byte_ids, longest

    @classmethod
    def read(cls, path: str, theta: float = 1.0) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelled, byte_ids = {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[3:5], 16)] = i
                spelled.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelled.append(b"")
            else:
                name = name.replace(SPACE, " ")
                spelled.append(name.encode())
                pieces[name] = (i, -theta * math.log(1 - model.get_score(i)))
        return cls(pieces, spelled, byte_ids, max(map(len, pieces), default=1))


class Lattices:
    """Forward filtering and backward sampling for many texts at once, in flat arrays.

    A text is cut wherever no piece of the vocabulary can span the two code points: every segmentation
    has a border there, so the parts are independent. Equal parts share one lattice. Nodes are numbered
    by depth, so that a depth's nodes, and the edges that end at them, lie side by side.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        chars = sorted({c for name in vocabulary.pieces for c in name})
        self.cls = np.zeros(0x110000, np.uint16)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.spans = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        held: dict[str, int] = {}
        for name, (i, _) in vocabulary.pieces.items():
            k = self.cls[[ord(c) for c in name]]
            self.spans[k[:-1], k[1:]] = True
            for n in range(1, len(name)):
                held.setdefault(name[:n], -1)
            held[name] = i
        self.weight = np.zeros(len(vocabulary.spelled))
        for i, w in vocabulary.pieces.values():
            self.weight[i] = w
        self.bits = max(8, int(len(held) * 4).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        names = list(held)
        hashes = np.zeros(len(names), np.uint64)
        lengths = np.array([len(x) for x in names])
        flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        at = np.cumsum(lengths) - lengths
        for k in range(int(lengths.max(initial=0))):
            live = lengths > k
            hashes[live] = self._next(hashes[live], flat[at[live] + k])
        if len(np.unique(hashes)) != len(names) or (hashes == 0).any():
            raise ValueError("two pieces share a 64-bit hash")
        for h, name in zip(hashes.tolist(), names, strict=True):
            slot = h >> (64 - self.bits)
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ids[slot] = h, held[name]

    @staticmethod
    def _next(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return ((h ^ (codes.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix of a piece, and the piece's id or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there, ids = self.keys[slot] == h, np.where(self.keys[slot] == h, self.ids[slot], -1)
        left = np.flatnonzero(~there & (self.keys[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            hit = left[met == h[left]]
            there[hit], ids[hit] = True, self.ids[slot[hit]]
            left = left[(met != 0) & (met != h[left])]
        return there, ids

    def _parts(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the parts start, how long they are, and the number of each one's kind."""
        cls = self.cls[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.spans[cls[:-1], cls[1:]]
        cut[starts] = True
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(codes)))
        local = np.arange(len(codes)) - np.repeat(begin, length)
        power = np.cumprod(np.full(int(length.max()), 0xD1342543DE82EF95, np.uint64))
        hashes = np.add.reduceat(mix64(codes.astype(np.uint64)) * power[local], begin)
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        same = (length == length[first[kind]]).all() and (codes == codes[np.repeat(begin[first[kind]] - begin, length) + np.arange(len(codes))]).all()
        if not same:  # two parts with one hash: tell them apart by their text
            text = [codes[b : b + n].tobytes() for b, n in zip(begin, length, strict=True)]
            _, first, kind = np.unique(np.array(text, object), return_index=True, return_inverse=True)
        return begin, length, np.stack([kind, first[kind]])

    def sample(self, codes: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: all texts' code points; starts: where each text starts. Returns all piece ids and each text's number of them."""
        begin, length, kinds = self._parts(codes, starts)
        _, which, kind = np.unique(kinds[1], return_index=True, return_inverse=True)
        size = length[which]
        order = np.argsort(-size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        kind, size, origin = rank[kind], size[order], begin[which][order]
        deep = int(size[0])
        wide = len(size) - np.searchsorted(size[::-1], np.arange(deep + 1), side="left")  # kinds of that depth or deeper
        offset = np.concatenate([[0], np.cumsum(wide)])

        # Edges by length: which kind, from which depth, which piece.
        t = np.repeat(np.arange(len(size)), size)
        depth = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
        at, h = origin[t] + depth, np.zeros(len(t), np.uint64)
        left = size[t] - depth
        found = []
        for n in range(1, self.v.longest + 1):
            h = self._next(h, codes[at + n - 1])
            prefix, ids = self._find(h)
            if n == 1:
                lone = ids < 0
                ids = np.where(lone, len(self.v.spelled) + codes[at], ids)
            hit = ids >= 0
            found.append((offset[depth[hit] + n] + t[hit], offset[depth[hit]] + t[hit], ids[hit].astype(np.int64)))
            live = prefix & (left > n)
            if not live.any():
                break
            t, depth, at, h, left = t[live], depth[live], at[live], h[live], left[live]
        nodes = int(offset[-1])
        counts = sum(np.bincount(f[0], minlength=nodes) for f in found)
        first = np.concatenate([[0], np.cumsum(counts)])
        source, piece, filled = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64), first[:-1].copy()
        for end, start, ids in found:
            place = filled[end]
            source[place], piece[place] = start, ids
            filled[end] += 1
        known = piece < len(self.v.spelled)
        value = np.where(known, self.weight[np.where(known, piece, 0)], 0.0)
        code = piece[~known] - len(self.v.spelled)
        value[~known] = -12.0 * (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))

        # Forward: the log of the summed weight at each node, depth by depth.
        total = np.zeros(nodes)
        for j in range(1, deep + 1):
            lo, hi = int(offset[j]), int(offset[j + 1])
            a, b = int(first[lo]), int(first[hi])
            value[a:b] += total[source[a:b]]
            top = np.maximum.reduceat(value[a:b], first[lo:hi] - a)
            total[lo:hi] = top + np.log(np.add.reduceat(np.exp(value[a:b] - np.repeat(top, counts[lo:hi])), first[lo:hi] - a))
        upto = np.cumsum(np.exp(value - np.repeat(total, counts)))
        below = np.concatenate([[0.0], upto])[first[:-1]]

        # Backward: every part draws an edge from where it stands, until all are at depth 0.
        node = offset[length] + kind
        sizes = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))
        number = np.arange(len(begin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seeds = mix64(np.repeat(seeds, sizes) + number.astype(np.uint64), 1)
        open_, steps, step = np.arange(len(begin)), [], 0
        drawn = np.zeros(len(begin), np.int64)
        while len(open_):
            here = node[open_]
            goal = below[here] + (mix64(seeds[open_], step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge, last = first[here], first[here + 1] - 1
            on = np.flatnonzero((upto[edge] <= goal) & (edge < last))
            while len(on):
                edge[on] += 1
                on = on[(upto[edge[on]] <= goal[on]) & (edge[on] < last[on])]
            steps.append((open_, piece[edge]))
            drawn[open_] += 1
            node[open_] = source[edge]
            open_ = open_[source[edge] >= wide[0]]
            step += 1
        ends = np.cumsum(drawn)
        ids = np.empty(int(ends[-1]), np.int64)
        for k, (who, what) in enumerate(steps):
            ids[ends[who] - 1 - k] = what
        per_text = np.add.reduceat(drawn, np.cumsum(sizes) - sizes)
        return self._spell(ids, per_text)

    def _spell(self, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece to their byte pieces."""
        odd = np.flatnonzero(ids >= len(self.v.spelled))
        if not len(odd):
            return ids.astype(np.int32), per_text
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[odd] - len(self.v.spelled)).tolist()]
        each = np.ones(len(ids), np.int64)
        each[odd] = [len(x) for x in spelled]
        out, ends = np.repeat(ids, each), np.cumsum(each)
        byte_ids = np.array(self.v.byte_ids)[np.frombuffer(b"".join(spelled), np.uint8)]
        out[np.repeat(ids, each) >= len(self.v.spelled)] = byte_ids
        text_ends = np.cumsum(per_text)
        return out.astype(np.int32), np.diff(np.concatenate([[0], ends[text_ends - 1]]))


def encode_texts(keys: list, texts: list[str | None], lattices: Lattices, seed: int = 0, chars_at_once: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: how many, the ids of the run, and each row's number of ids."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < chars_at_once):
            size += len(texts[hi] or "")
            hi += 1
        held = [i for i in range(lo, hi) if texts[i]]
        counts = np.zeros(hi - lo, np.int64)
        ids = np.empty(0, np.int32)
        if held:
            sizes = np.array([len(texts[i]) + 1 for i in held])
            codes = np.frombuffer("".join(" " + texts[i] for i in held).encode("utf-32-le", "surrogatepass"), np.uint32)
            seeds = np.array([xxhash.xxh3_64_intdigest("null" if keys[i] is None else str(keys[i]), seed=seed) for i in held], np.uint64)
            ids, counts[[i - lo for i in held]] = lattices.sample(codes, np.cumsum(sizes) - sizes, seeds)
        yield hi - lo, ids, counts
        lo = hi


def _encode(names: list[str], key_at: int, text_at: int, vocabulary: Vocabulary, seed: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary)
        for batch in batches:
            at, texts = 0, batch.column(text_at).to_pylist()
            for n, ids, counts in encode_texts(batch.column(key_at).to_pylist(), texts, lattices, seed):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()), mask=pa.array([x is None for x in texts[at : at + n]]))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns, lists], [*names, out])
                at += n

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, key_col: str = "doc_id", text_col: str = "text", out: str = "pieces", seed: int = 0) -> DataFrame:
    """docs with the sampled piece ids of text_col."""
    docs = without(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lean(_encode(docs.columns, docs.columns.index(key_col), docs.columns.index(text_col), vocabulary, seed, out)), schema)


def decode_ids(ids: list[int], spelled: list[bytes]) -> str:
    return b"".join(map(spelled.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _decode(names: list[str], pieces_at: int, spelled: list[bytes], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(pieces_at)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            null = lists.is_null().to_pylist()
            texts = [None if x else decode_ids(flat[a:b].tolist(), spelled) for a, b, x in zip(ends[:-1], ends[1:], null, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return run


def decode(df: DataFrame, vocabulary: Vocabulary, pieces_col: str = "pieces", out: str = "decoded") -> DataFrame:
    """df with the text that the piece ids spell."""
    df = without(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.mapInArrow(lean(_decode(df.columns, df.columns.index(pieces_col), vocabulary.spelled, out)), schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """decode(encode(docs)): docs with pieces and decoded, both by one Python worker a task instead of two."""
    docs = without(docs, "pieces", "decoded")
    names = docs.columns
    first, then = _encode(names, names.index(key_col), names.index(text_col), vocabulary, seed, "pieces"), _decode([*names, "pieces"], len(names), vocabulary.spelled, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(lean(lambda batches: then(first(batches))), schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    both = round_trip(documents(spark, sf_dir).select("doc_id", "text"), Vocabulary.read(MODEL))
    return both.select(
        "doc_id",
        F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
