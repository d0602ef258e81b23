"""Phrase collocations by level-wise passes: frequent words, then longer runs of words whose shorter runs are frequent.

A-Z are lower-cased; texts fall into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs; a phrase
lies within one piece. Everything is counted for each language by itself (a null language is ``und``).

Level 1 counts words. The pass for level k broadcasts a bitmap of the frequent phrases of k-1 words and emits a run of k
words only where both runs of k-1 words in it are set, as the pair of their numbers, counted within the task before
any shuffle. The bitmap has 64 bits for each frequent phrase, at most 2 ** ``most_bits`` (32 MB): its size never grows
beyond that, and bits set by chance only emit runs which the exact counts then leave out. A phrase's number is a hash of
its two parts' numbers, which starts at its words' hashes; those are checked to be one for each word, else other ones are taken.

Level tables hold each frequent phrase's count, and those of all its beginnings and ends, gained from its two parts by two
joins of level tables; so its cuts are scored within the row, in decimals of 38 digits. A phrase goes if one that
is a word longer and holds it is about as frequent; longer ones hold such a one.

Long texts are cut between words into slices that begin with the last k-1 words of the slice before, so that each run of k
words lies whole in exactly one. Null and empty texts have no words; repeated rows count as often as they are there; other
columns than text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TokenHasher, documents, lean, mix64, staged

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
#: Words of a task that are counted at once.
HELD = 1 << 21


def slices(text: np.ndarray, hasher: TokenHasher, words: int, most: int) -> Iterator[np.ndarray]:
    """Parts of a text's bytes that end between words, each with the last words-1 words of the one before."""
    lo, size = 0, most
    while lo < len(text):
        cut = lo + size
        while cut < len(text) and hasher.word[text[cut]]:
            cut += 1
        part = text[lo:cut]
        if cut >= len(text):
            yield part
            return
        at = hasher.located(part, np.array([0, len(part)]))[2]
        if len(at) < words:  # too few in so many bytes
            size *= 2
            continue
        yield part
        lo, size = lo + int(at[-(words - 1)]) if words > 1 else cut, most


def blocks(batch: pa.RecordBatch, hasher: TokenHasher, words: int, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, bounds): texts of a batch (lang, text), long ones in slices, about most bytes at once."""
    column = batch.column(1).cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        if hi > lo:
            yield np.arange(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
        else:
            for part in slices(data[offsets[lo] : offsets[lo + 1]], hasher, words, most):
                yield np.array([lo]), part, np.array([0, len(part)])
            lo += 1


def joined(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The number of a phrase from those of its first and last k-1 words."""
    with np.errstate(over="ignore"):
        return mix64(p * np.uint64(0x9E3779B97F4A7C15) + (s << np.uint64(31) | s >> np.uint64(33)), 5)


class Words:
    """Word numbers of blocks of texts, and which of them follow one another within a piece."""

    def __init__(self, seed: int):
        self.hasher, self.salts = TokenHasher(BREAKS + BLANKS, seed), {}
        self.breaks = np.zeros(256, bool)
        self.breaks[list(BREAKS)] = True

    def salt(self, lang: str | None) -> int:
        lang = "und" if lang is None else lang
        if lang not in self.salts:
            self.salts[lang] = xxhash.xxh3_64_intdigest(lang.encode())
        return self.salts[lang]

    def of(self, rows: np.ndarray, langs: list, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, follows, first bytes, lengths, row of each word); follows[i]: word i+1 stands in word i's piece."""
        hashes, sizes, at, lengths = self.hasher.located(data, bounds)
        owner = np.repeat(np.arange(len(rows)), sizes)
        salts = np.array([self.salt(langs[r]) for r in rows], np.uint64)
        piece = np.cumsum(self.breaks[data], dtype=np.int64)[at] if len(at) else at
        follows = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
        return mix64(hashes ^ salts[owner], 7), follows, at, lengths, owner


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(seed), {}

        def flush():
            rows = list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()), pa.array(np.array([r[2] for r in rows], np.uint64).view("i8")), pa.array([r[3] for r in rows], pa.int64())], ["lang", "word", "h", "a"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, data, bounds in blocks(batch, words.hasher, 1):
                numbers, _, at, lengths, owner = words.of(rows, langs, data, bounds)
                found, first, counts = np.unique(numbers, return_index=True, return_counts=True)
                for h, a, n, row, k in zip(found.tolist(), at[first].tolist(), lengths[first].tolist(), rows[owner[first]].tolist(), counts.tolist(), strict=True):
                    if h in held:
                        held[h][3] += k
                    else:
                        held[h] = ["und" if langs[row] is None else langs[row], data[a : a + n].tobytes().lower(), h, k]
                if len(held) > 1 << 19:
                    yield flush()
        yield flush()

    return run


def _count_runs(seed: int, k: int, bitmap, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ps, ss, n = Words(seed), [], [], 0
        frequent, shift = bitmap.value, np.uint64(64 - bits)

        def flush():
            p, s = np.concatenate(ps or [np.empty(0, np.uint64)]), np.concatenate(ss or [np.empty(0, np.uint64)])
            order = np.lexsort((s, p))
            p, s = p[order], s[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(p)), bool), (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))
            ps.clear()
            ss.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[first].view("i8")), pa.array(s[first].view("i8")), pa.array(np.diff(np.append(first, len(p))).astype(np.int64))], ["p", "s", "a"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, data, bounds in blocks(batch, words.hasher, k):
                g, follows, *_ = words.of(rows, langs, data, bounds)
                whole = follows  # runs of two words from each place; longer ones by and
                for j in range(2, k):
                    g, whole = joined(g[:-1], g[1:]), whole[:-1] & follows[j - 1 :]
                at = g >> shift
                there = frequent[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0
                keep = there[:-1] & there[1:] & whole
                ps.append(g[:-1][keep])
                ss.append(g[1:][keep])
                n += int(keep.sum())
                if n > HELD:
                    yield flush()
                    n = 0
        yield flush()

    return run


def bitmap_of(level: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """Bits of the frequent phrases' numbers by their highest digits; at most 2 ** (most_bits - 6) words of it come to the driver."""
    bits = min(most_bits, max(12, int(64 * level.count()).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    rows = level.select(F.shiftrightunsigned(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    rows = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view("u8")
    return out, bits


def number_of(p: pd.Series, s: pd.Series) -> pd.Series:
    """joined() of columns, for the rows of level tables: its products wrap, which SQL's don't."""
    return pd.Series(joined(p.to_numpy(np.int64).view("u8"), s.to_numpy(np.int64).view("u8")).view("i8"))


def levels_of(docs: DataFrame, min_count: int, max_words: int, most_bits: int, lang_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all languages, and a table of frequent phrases for each number of words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    for seed in range(97, 200):
        words = texts.mapInArrow(lean(_count_words(seed)), "lang string, word string, h long, a long").groupBy("lang", "word", "h").agg(F.sum("a").alias("a"))
        words = staged(words, "phrase-words")
        if not words.groupBy("h").count().filter("count > 1").limit(1).count():
            break
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= min_count)
    none = F.lit(None).cast("long")
    levels = [staged(frequent.select("h", none.alias("p"), none.alias("s"), "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("begins"), F.array("a").alias("ends")), "phrases-1")]
    for k in range(2, max_words + 1):
        bitmap, bits = bitmap_of(levels[-1], most_bits)
        sent = spark.sparkContext.broadcast(bitmap)
        runs = texts.mapInArrow(lean(_count_runs(seed, k, sent, bits)), "p long, s long, a long")
        runs = runs.groupBy("p", "s").agg(F.sum("a").alias("a")).filter(F.col("a") >= min_count)
        own = levels[-1]
        first = own.select(F.col("h").alias("p"), "lang", F.col("phrase").alias("_p"), F.col("begins").alias("_b"))
        then = own.select(F.col("h").alias("s"), "last", F.col("ends").alias("_e"))
        found = runs.join(first, "p").join(then, "s")
        found = found.select(F.pandas_udf(number_of, "long")("p", "s").alias("h"), "p", "s", "a", "lang", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", F.concat("_b", F.array("a")).alias("begins"), F.concat("_e", F.array("a")).alias("ends"))
        levels.append(staged(found, f"phrases-{k}"))
        sent.destroy()
    return totals, levels


#: The cuts of a phrase as structs, the least first in order: floor(1000 a n / (l r)) in decimals, which hold both products.
CUTS = """transform(sequence(1, size(begins) - 1), k -> struct(
    (cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(begins[k - 1] as decimal(18, 0)) * cast(ends[size(begins) - k - 1] as decimal(18, 0))) as score,
    k as k, begins[k - 1] as l, ends[size(begins) - k - 1] as r))"""


def mine(docs: DataFrame, min_count: int = 100, max_words: int = 5, share: int = 100, first: int = 2000, most_bits: int = 28, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by their weakest cut.

    A phrase that a longer one holds goes if the longer one has share percent of its occurrences.
    """
    if max_words < 2:
        raise ValueError("phrases have at least two words")
    totals, levels = levels_of(docs, min_count, max_words, most_bits, lang_col, text_col)
    kept = []
    for k, level in enumerate(levels[1:], 2):
        rows = level.select("h", "lang", "phrase", "a", "begins", "ends")
        if k < max_words:
            longer = levels[k].select(F.explode(F.array("p", "s")).alias("h"), F.col("a").alias("_a")).groupBy("h").agg(F.max("_a").alias("_a"))
            rows = rows.join(longer, "h", "left").filter(F.coalesce(100 * F.col("_a") < share * F.col("a"), F.lit(True))).drop("_a")
        kept.append(rows)
    rows = reduce(DataFrame.unionByName, kept).join(totals, "lang").withColumn("cut", F.array_min(F.expr(CUTS)))
    rows = rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return rows.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= first)


def op13_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir).select("lang", "text")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM placed GROUP BY ALL),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
cuts AS (SELECT lang, phrase, a, k, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS p, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS s FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT u.lang, u.phrase, u.a, u.k, u.j, x.a AS l, y.a AS r, n, ((1000::HUGEINT * u.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.p JOIN f y ON y.lang = u.lang AND y.phrase = u.s JOIN total t ON t.lang = u.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM least q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = q.lang AND c.k > q.k AND 100 * c.a >= 100 * q.a AND contains(' ' || c.phrase || ' ', ' ' || q.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
