"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts, for the benchmark's terms, in how many passages of ``passage_words``
   words each occurs, and sums a random sketch of the passages' term co-occurrence.
2. Randomised SVD (Nystroem, single pass): TF-IDF passages of the corpus and of the benchmark, stacked, the
   corpus with ``corpus_share`` of the energy, give the leading right singular vectors: the latent space.
3. Documents slide windows of the benchmark items' lengths (in classes) over their words; windows with
   enough benchmark terms are compared with all items of their length by cosine in the latent space.
4. A candidate is confirmed by the longest common subsequence of words between the item and the text around
   the window: at least ``copied`` of the item is a copy; at least ``paraphrased`` of it is a paraphrase if
   most of its answer is there too, in its order, and most of the item's words, both by their IDF weights. The answer is
   what follows the item's last question mark or "answer:", else its last quarter.

The benchmark is a stated query set. It is read in blocks of ``block_items`` items, so that what goes to the
tasks is bounded whatever its size; all documents, whole, are compared with each block.

Items of fewer than ``least_words`` words are too short for windows: they are found where all their words stand
one after the other, as copies.

Words are lower-cased and cut at white space and ASCII punctuation. Null or empty texts and items match
nothing. Rows with a null id are not reported. Repeated rows
report the same pair once. An empty benchmark or an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenHasher, documents, give_back, lean, staged

#: ASCII white space and punctuation.
BLANKS = bytes([*range(9, 14), *range(32, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
ANSWER = re.compile(r"\?|\banswer\s*:", re.I)
PIECE_WORDS = 1 << 14
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, word_at long, verdict string"


class Terms:
    """The benchmark's words by their hashes; a word's id is its hash's place."""

    def __init__(self, texts: list[str]):
        self.hasher = TokenHasher(BLANKS)
        hashes = [h for _, _, h, _ in self.hasher.chunks(pc.utf8_lower(pa.array(texts, pa.string())))]
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)

    def __len__(self) -> int:
        return len(self.hashes)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, term ids) of each text, -1 for words that the benchmark doesn't have."""
        for lo, _, hashes, sizes in self.hasher.chunks(pc.utf8_lower(column.cast(pa.string()))):
            ids, ends = self.ids(hashes), np.cumsum(sizes).tolist()
            for i, (n, end) in enumerate(zip(sizes.tolist(), ends, strict=True)):
                yield lo + i, ids[end - n : end]


def _pieces(batches: Iterator[pa.RecordBatch], text_at: int, terms: Terms, overlap: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(batch, row, first word, term ids) of pieces of at most PIECE_WORDS and overlap words."""
    for n, batch in enumerate(batches):
        for row, ids in terms.texts(batch.column(text_at)):
            for at in range(0, max(1, len(ids) - overlap), PIECE_WORDS):
                yield n, row, at, ids[at : at + PIECE_WORDS + overlap]


def _gather(terms: Terms, seed: int, width: int, passage_words: int):
    """A task's passages: each term's number of them, and its rows of T'T Omega, in chunks of 64 terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(terms)
        omega = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32)
        df, sketch, passages = np.zeros(size), np.zeros((size, width)), 0
        held, total = [], 0

        def add() -> None:
            """Terms that are common in these passages by dense products, the others row by row."""
            nonlocal passages
            keys, n = [], 0
            for ids in held:
                known = np.flatnonzero(ids >= 0)
                keys.append((n + known // passage_words) * size + ids[known])
                n += -(-len(ids) // passage_words)
            passages += n
            keys = np.concatenate(keys)
            keys.sort()
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
            if not len(keys):
                return
            passage, term = keys // size, keys % size
            here = np.bincount(term, minlength=size)
            df[:] += here
            common = np.flatnonzero(here >= n // 32 + 1)
            column = np.full(size, -1)
            column[common] = np.arange(len(common))
            frequent = column[term] >= 0
            dense = np.zeros((n, len(common)), np.float32)
            dense[passage[frequent], column[term[frequent]]] = 1
            sums = dense @ omega[common]
            rare_passage, rare_term = passage[~frequent], term[~frequent]
            if len(rare_term):
                start = np.flatnonzero(np.diff(rare_passage, prepend=-1))
                sums[rare_passage[start]] += np.add.reduceat(omega[rare_term], start)
                order = np.argsort(rare_term, kind="stable")
                first = np.flatnonzero(np.diff(rare_term[order], prepend=-1))
                sketch[rare_term[order][first]] += np.add.reduceat(sums[rare_passage[order]], first)
            sketch[common] += dense.T @ sums

        for _, _, _, ids in _pieces(batches, 0, terms, 0):
            held.append(ids)
            total += len(ids)
            if total >= 1 << 18:
                add()
                held, total = [], 0
        if held:
            add()
        if passages:
            for c in range(0, size, 64):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([passages], pa.int64()), pa.array([np.column_stack([df[c : c + 64], sketch[c : c + 64]]).tobytes()], pa.binary())], ["chunk", "passages", "sums"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each chunk; a task holds one sum for each of its chunks."""
    sums: dict[int, np.ndarray] = {}
    passages: dict[int, int] = {}
    for batch in batches:
        for chunk, n, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            x = np.frombuffer(blob)
            sums[chunk] = sums[chunk] + x if chunk in sums else x
            passages[chunk] = passages.get(chunk, 0) + n
    for chunk, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([passages[chunk]], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["chunk", "passages", "sums"])


def nystroem(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive semidefinite M, from M @ omega."""
    shift = 1e-7 * np.linalg.norm(sketch) + 1e-300
    moved = sketch + shift * omega
    core = omega.T @ moved
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max() * 1e-10
    vectors, values, _ = np.linalg.svd(moved @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return vectors[:, :rank]


@dataclass
class Space:
    """The items of a block in the latent space."""

    terms: Terms
    idf: np.ndarray
    basis: np.ndarray  # by term: idf times the singular vectors
    item_ids: np.ndarray
    items: list[np.ndarray]
    answers: list[int]  # words of each item's answer, its last ones
    latent: np.ndarray
    classes: list[tuple[int, np.ndarray]]  # window length, items of that length


def length_classes(lengths: np.ndarray, ratio: float = 1.5) -> list[tuple[int, np.ndarray]]:
    """(window length n, items of less than n * sqrt(ratio) words, from where the class before ends): each item is in one."""
    out, n, begin, end = [], int(lengths.min()), 0.0, 0.0
    while end <= lengths.max():
        end = n * ratio**0.5
        own = np.flatnonzero((lengths >= begin) & (lengths < end))
        if len(own):
            out.append((n, own))
        n, begin = max(n + 1, int(n * ratio)), end
    assert sum(len(own) for _, own in out) == len(lengths)
    return out


def space_of(docs: DataFrame, item_ids: list[int], texts: list[str], rank: int, passage_words: int, corpus_share: float, least_words: int, text_col: str) -> Space | None:
    terms = Terms(texts)
    coded = [ids for _, ids in terms.texts(pa.array(texts, pa.string()))]
    held = [i for i, ids in enumerate(coded) if len(ids) >= least_words]
    if not held:
        return None
    items = [coded[i] for i in held]
    size = len(terms)
    rank = min(rank, size)
    width = min(size, rank + 16)
    rows = docs.select(F.col(text_col)).mapInArrow(lean(_gather(terms, 11, width, passage_words)), "chunk int, passages long, sums binary")
    tasks = max(1, min(-(-size // 64), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    got = staged(rows.repartition(tasks, "chunk").mapInArrow(lean(_add_up), "chunk int, passages long, sums binary"), "term-sums").collect()  # one row for 64 terms
    sums = np.zeros((size, 1 + width))
    for row in got:
        sums[row.chunk : row.chunk + 64] = np.frombuffer(row.sums).reshape(-1, 1 + width)
    passages = max((r.passages for r in got), default=0)
    df, sketch = sums[:, 0], sums[:, 1:]
    idf = np.log(2 + passages / (1 + df))
    omega = np.random.default_rng(11).standard_normal((size, width)) / idf[:, None]

    # M = A'A of both kinds of passages, each with its share of the trace; (idf T)'(idf T) (Omega / idf) = idf T'T Omega.
    of_corpus = idf[:, None] * sketch / max(1e-9, float((idf * idf * df).sum()))
    of_items, trace = np.zeros_like(of_corpus), 0.0
    for x in items:
        for at in range(0, len(x), passage_words):  # passages as the corpus's: each word once, by its IDF
            term = np.unique(x[at : at + passage_words])
            a = idf[term]
            of_items[term] += a[:, None] * (a @ omega[term])
            trace += float(a @ a)
    basis = nystroem(corpus_share * of_corpus + (1 - corpus_share) * of_items / trace, omega, rank)
    basis = (idf[:, None] * basis).astype(np.float32)
    latent = np.stack([basis[x].sum(axis=0) for x in items])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    del got, sums, df, sketch, omega, of_corpus, of_items
    give_back()
    answers = [answer_words(texts[i], len(coded[i]), terms) for i in held]
    return Space(terms, idf, basis, np.array([item_ids[i] for i in held]), items, answers, latent, length_classes(np.array([len(x) for x in items])))


def bits_of(item: np.ndarray) -> dict[int, int]:
    """For each word, a bit for each of its places in the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | (1 << k)
    return places


def common_subsequence(item: np.ndarray, text: np.ndarray, places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, a bit for each word of item."""
    places = bits_of(item) if places is None else places
    row = full = (1 << len(item)) - 1
    for w in text.tolist():
        if w in places:
            hit = row & places[w]
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def answer_words(text: str, n: int, terms: Terms) -> int:
    """How many of an item's n words are its answer: those behind its last question mark or "answer:", else the last quarter."""
    after = ANSWER.split(text)[-1] if ANSWER.search(text) else ""
    found = sum(len(ids) for _, ids in terms.texts(pa.array([after], pa.string())))
    return found if 0 < found < n else max(1, n // 4)


def weighed_subsequence(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> float:
    """The largest weight of a common subsequence of item and text, as a share of the item's weight."""
    best = np.zeros(len(item) + 1)
    for w in text[np.isin(text, item)].tolist():
        here = np.concatenate([[0.0], best[:-1] + np.where(item == w, weight[item], 0.0)])
        best = np.maximum.accumulate(np.maximum(best, here))
    return float(best[-1] / max(1e-12, weight[item].sum()))


def judge(item: np.ndarray, text: np.ndarray, idf: np.ndarray, copied: float, paraphrased: float, answer: int, places: dict[int, int] | None = None) -> tuple[float, float, str | None]:
    """Shares of the item and of its answer (the last ``answer`` words) in the text, and the verdict.

    A common subsequence has no more words than the item has in the text at all, which settles most windows.
    """
    places = bits_of(item) if places is None else places
    there = 0
    for w in set(text.tolist()):
        there |= places.get(w, 0)
    if there.bit_count() < paraphrased * len(item):
        return there.bit_count() / len(item), 0.0, None
    whole = common_subsequence(item, text, places) / len(item)
    if whole < paraphrased:
        return whole, 0.0, None
    share = weighed_subsequence(item[-answer:], text, idf)
    if whole >= copied:
        return whole, share, "copy"
    terms = np.unique(item)
    weight = idf[terms[np.isin(terms, text)]].sum() / idf[terms].sum()
    return whole, share, "paraphrase" if share >= 0.6 and weight >= 0.5 else None


def running_sums(x: np.ndarray, block: int = 16) -> np.ndarray:
    """Sums of the first 0, 1, ... rows: products with a triangle within blocks, then the blocks' own sums."""
    n, width = x.shape
    padded = np.zeros((-(-n // block) * block + 1, width), x.dtype)
    padded[1 : n + 1] = x
    blocks = padded[1:].reshape(-1, block, width)
    within = np.tri(block, dtype=x.dtype) @ blocks
    within[1:] += np.cumsum(within[:-1, -1], axis=0)[:, None]
    padded[1:] = within.reshape(-1, width)
    return padded[: n + 1]


def _windows(lengths: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which piece, from where, to where: windows of n words a quarter apart, the last one flush with the end."""
    step = max(1, n // 4)
    count = np.maximum(0, -(-(lengths - n) // step)) + 1
    piece = np.repeat(np.arange(len(lengths)), count)
    k = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(k * step, np.maximum(0, lengths[piece] - n))
    return piece, starts[piece] + at, starts[piece] + np.minimum(at + n, lengths[piece])


def _retrieve(shared, least_cosine: float, copied: float, paraphrased: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        places = [bits_of(x) for x in space.items]
        longest = max(n for n, _ in space.classes)
        held_batches: list[pa.RecordBatch] = []

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held_batches.append(batch)
                yield batch

        def search(pieces: list) -> list[tuple]:
            lengths = np.array([len(p[3]) for p in pieces])
            ids = np.concatenate([p[3] for p in pieces])
            starts = np.cumsum(lengths) - lengths
            known = np.concatenate([[0], np.cumsum(ids >= 0)])
            run_sums = running_sums(space.basis[ids[ids >= 0]])  # over the known words only
            candidates: dict[tuple, list] = {}
            for n, own in space.classes:
                piece, lo, hi = _windows(lengths, starts, n)
                fit = known[hi] - known[lo] >= max(1, 0.4 * n)
                piece, lo, hi, latent = piece[fit], lo[fit], hi[fit], space.latent[own]
                for a in range(0, len(lo), 4096):
                    z = run_sums[known[hi[a : a + 4096]]]
                    z -= run_sums[known[lo[a : a + 4096]]]
                    length = np.sqrt(np.einsum("ij,ij->i", z, z))
                    near = z @ latent.T
                    hits = np.flatnonzero((near >= least_cosine * np.maximum(length, 1e-9)[:, None]).ravel())
                    for w, i in zip(*np.divmod(hits, len(own)), strict=True):
                        _, row, first, _ = p = pieces[piece[a + w]]
                        doc = held_batches[p[0]].column(0)[row].as_py()
                        candidates.setdefault((doc, own[i]), []).append((float(near[w, i] / length[w]), int(lo[a + w]), n, int(piece[a + w]), first))
            out = []
            for (doc, i), windows in candidates.items():
                item, best = space.items[i], None
                tried = -1
                for cosine, lo, n, k, first in sorted(windows, reverse=True):
                    a, b = int(starts[k]), int(starts[k] + lengths[k])
                    if tried >= 0 and abs(lo - tried) < n // 8:
                        continue
                    tried = lo
                    around = ids[max(a, lo - len(item) // 2) : min(b, lo + n + len(item) // 2)]
                    whole, answer, verdict = judge(item, around, space.idf, copied, paraphrased, space.answers[i], places[i])
                    if verdict and (best is None or whole > best[3]):
                        best = (doc, int(space.item_ids[i]), cosine, whole, answer, first + lo - a, verdict)
                    if best and best[6] == "copy":
                        break
                if best:
                    out.append(best)
            return out

        pieces, size = [], 0
        for p in _pieces(kept(), 1, space.terms, 2 * longest):
            pieces.append(p)
            size += len(p[3])
            if size >= PIECE_WORDS:
                if rows := search(pieces):
                    yield _found(rows)
                for old in range(p[0]):
                    held_batches[old] = None
                pieces, size = [], 0
        if pieces and (rows := search(pieces)):
            yield _found(rows)

    return run


class ShortItems:
    """Items too short for windows, as a tree of their words."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        self.terms, tree = Terms(texts), {}
        self.ends: dict[int, list[int]] = {}
        for item_id, (_, ids) in zip(item_ids, self.terms.texts(pa.array(texts, pa.string())), strict=True):
            node = 0
            for w in ids.tolist():
                node = tree.setdefault(node * len(self.terms) + w, len(tree) + 1)
            if node:
                self.ends.setdefault(node, []).append(item_id)
        self.moves = np.array(sorted(tree), np.int64)
        self.nodes = np.array([tree[x] for x in sorted(tree)], np.int64)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, its first word's place) of each item whose words stand in ids one after the other."""
        start = np.arange(len(ids))
        node, depth = np.zeros(len(ids), np.int64), 0
        while True:
            there = start + depth < len(ids)
            start, node = start[there], node[there]
            words = ids[start + depth]
            key = np.where(words >= 0, node * len(self.terms) + words, -1)
            at = np.searchsorted(self.moves, key)
            at[at == len(self.moves)] = 0
            met = np.flatnonzero(self.moves[at] == key)
            if not len(met):
                return
            start, node, depth = start[met], self.nodes[at[met]], depth + 1
            for reached, first in zip(*np.unique(node, return_index=True), strict=True):
                for item_id in self.ends.get(int(reached), ()):
                    yield item_id, int(start[first])


def _find_short(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ShortItems = shared.value
        for batch in batches:
            if rows := [(batch.column(0)[row].as_py(), item_id, 1.0, 1.0, 1.0, at, "copy") for row, ids in items.terms.texts(batch.column(1)) for item_id, at in items.find(ids)]:
                yield _found(rows)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 96, passage_words: int = 64, corpus_share: float = 0.1, least_cosine: float = 0.7, copied: float = 0.8, paraphrased: float = 0.5, least_words: int = 8, block_items: int = 4096) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, word_at, verdict): benchmark items that documents hold, each pair once."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).dropna().distinct()
    blocks = max(1, -(-items.count() // block_items))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about block_items rows
        space = space_of(texts, [r.item_id for r in block], [r.text for r in block], rank, passage_words, corpus_share, least_words, "text") if block else None
        sizes = [len(ids) for _, ids in Terms([]).texts(pa.array([r.text for r in block], pa.string()))]
        short = [r for r, n in zip(block, sizes, strict=True) if 0 < n < least_words]
        if short:
            out = out.unionByName(texts.mapInArrow(lean(_find_short(spark.sparkContext.broadcast(ShortItems([r.item_id for r in short], [r.text for r in short])))), FOUND))
        if space is not None:
            out = out.unionByName(texts.mapInArrow(lean(_retrieve(spark.sparkContext.broadcast(space), least_cosine, copied, paraphrased)), FOUND))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "cosine", "answer", "word_at", "verdict")).alias("x"))
    return best.select("doc_id", "item_id", "x.cosine", "x.lcs", "x.answer", "x.word_at", "x.verdict")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
