"""Language ID with error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed character n-grams learns each bit.
A text's classifiers vote with real-valued margins, and the codeword of least weighted loss wins. A
bit weighs, for each language, what its classifier got right of that language's training rows.

The classifiers are fitted on a bounded sample: ``sample_rows`` divided by the number of languages, but at least
one row, of each language: those of the smallest hashes of their ids (then of their texts), whatever the order
or the partitions of the table. Everything else reads all rows.

A null text, or one without a letter (Unicode's categories L; digits, fractions and Roman numerals are none), is
``und`` with score 0 and is not ambiguous. Training rows need
a text, a language and an id; without any, every row is ``und``. With one language every text that
has a letter is of it, with score 1. Empty tables give empty results. Columns of the input named like
the added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc_mod, documents, give_back, lean, relieve, staged, without

DIMS = 1 << 12
PIECE = 1 << 16


@cache
def _letters() -> np.ndarray:
    """Code points of the basic plane that are no letters, as spaces."""
    return np.array([c if 0xD800 > c or c > 0xDFFF else 32 for c in range(0x10000)], np.uint32) * np.array([chr(c).isalpha() for c in range(0x10000)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts_of(text: str) -> np.ndarray:
    """How many 1-, 2- and 3-grams of letters fall into each of DIMS classes; texts of any length, in pieces."""
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(text), PIECE):
        piece = text[max(0, at - 2) : at + PIECE].lower()
        codes = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        low = codes < 0x10000
        codes = np.where(low, _letters()[np.where(low, codes, 0)], codes)
        codes = np.concatenate([[0], codes, [0]]).astype(np.uint32)
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams, there in ((one, codes > 0), (two, (codes[1:] > 0) | (codes[:-1] > 0)), (three, codes[1:-1] > 0)):
            out += np.bincount(grams[there] >> np.uint32(20), minlength=DIMS)
    return out


def unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code up to 6 languages, beyond that random ones of 15 log2(n) bits."""
    if n <= 6:
        columns = [[1 - 2 * ((c >> i) & 1) for i in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(columns, np.float32).reshape(-1, n).T
    rng, bits = np.random.default_rng(20), int(15 * np.log2(n))
    columns = []
    while len(columns) < bits:
        c = rng.integers(0, 2, n) * 2 - 1
        if abs(int(c.sum())) < n:
            columns.append(c)
    return np.array(columns, np.float32).T


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray, sharpness: float):
        self.langs, self.code, self.weights, self.trust, self.sharpness = langs, code, weights, trust, sharpness

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str], ridge: float = 0.05, sharpness: float = 8.0) -> Model:
        langs = sorted(set(lang))
        code, y = codewords(len(langs)), np.array([langs.index(x) for x in lang], int)
        if len(langs) < 2:
            return cls(langs, code, np.zeros((DIMS, 0), np.float32), np.zeros((len(langs), 0), np.float32), sharpness)
        kernel, target = (x @ x.T).astype(np.float64), code[y].astype(np.float64)
        kernel[np.diag_indices(len(x))] += ridge
        inverse = np.linalg.inv(kernel)
        del kernel
        dual = inverse @ target
        left_out = target - dual / np.diag(inverse)[:, None]  # each row's margins by the classifiers fitted without it
        right = (left_out * target > 0).astype(np.float64)
        trust = np.array([right[y == i].mean(axis=0) for i in range(len(langs))]) + 1e-6
        return cls(langs, code, x.T @ dual.astype(np.float32), (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32), sharpness)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss), and by how much its loss is less than the next one's."""
        if len(self.langs) < 2:
            return np.zeros(len(counts), int), np.ones(len(counts)), np.full(len(counts), np.inf)
        margins = unit(counts) @ self.weights
        loss = np.stack([np.exp(-margins * word) @ trust for word, trust in zip(self.code, self.trust, strict=True)], axis=1)
        ranked = np.sort(loss, axis=1)
        share = np.exp(-self.sharpness * (loss - ranked[:, :1]))
        return loss.argmin(axis=1), 1 / share.sum(axis=1), ranked[:, 1] - ranked[:, 0]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([zlib.compress(counts_of(x).astype("<u4").tobytes(), 1) for x in part.column(1).to_pylist()], pa.binary())], ["lang", "counts"])


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 2000) -> Model | None:
    """A model of at most sample_rows labelled rows, as many of each language; None without any."""
    rows = training.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    sizes = staged(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    langs = sizes.count()
    if not langs:
        return None
    each = max(1, sample_rows // langs)
    sent = F.broadcast if langs <= 1 << 16 else lambda df: df
    # Each language's hash up to which its rows are taken, ranked among its lowest hashes only: about four times the rows to
    # take, however many it has. Should a language have fewer there than it must give (one id many times), all are ranked.
    share = F.least(F.lit(1.0), 4.0 * each / F.col("n"))
    low = rows.select("lang", "h").join(sent(sizes), "lang").filter(F.col("h").cast("double") <= share * 2.0**64 - 2.0**63)
    short = sizes.join(sent(low.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))), "lang", "left").filter(F.coalesce("k", F.lit(0)) < F.least(F.col("n"), F.lit(each)))
    low = rows if short.limit(1).count() else low
    by_hash = Window.partitionBy("lang").orderBy("h")
    edges = sent(low.select("lang", "h").withColumn("r", F.row_number().over(by_hash)).filter(F.col("r") <= each).groupBy("lang").agg(F.max("h").alias("edge")))
    taken = rows.join(edges, "lang").filter(F.col("h") <= F.col("edge")).withColumn("r", F.row_number().over(by_hash.orderBy("h", F.xxhash64("text")))).filter(F.col("r") <= each)
    got = taken.select("lang", "text").mapInArrow(lean(_count_rows), "lang string, counts binary").toArrow()
    if not len(got):
        return None
    x, names = np.empty((len(got), DIMS), np.float32), got.column(0).to_pylist()
    for i, blob in enumerate(got.column(1)):
        x[i] = unit(np.frombuffer(zlib.decompress(blob.as_py()), "<u4"))
    del got
    give_back()
    model = Model.fit(x, names)
    del x
    relieve(training.sparkSession, 0)
    return model


def _predict(model: Model | None, names: list[str], text_at: int, ambiguous_below: float, at_once: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), at_once):
                part = batch.slice(lo, at_once)
                texts = part.column(text_at).to_pylist()
                known = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
                lang, score, tied = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if known:
                    best, share, lead = model.decode(np.stack([counts_of(texts[i]) for i in known]))
                    score[known], tied[known] = share, lead < ambiguous_below
                    for i, k in zip(known, best, strict=True):
                        lang[i] = model.langs[k]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(tied)], [*names, "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous_below: float = 0.02) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous: two codewords were nearly as near."""
    docs = without(docs, "lang_pred", "score", "ambiguous")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(lean(_predict(model, docs.columns, docs.columns.index(text_col), ambiguous_below)), schema)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(crc_mod(id_col, folds) == fold, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
