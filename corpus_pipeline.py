"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents. run() writes each stage's result as Parquet to the shared folder and reads it
again as the next one's input. Arrow batches have few rows in all stages, which keeps workers small. No stage
of it but line dedup is SQL, so ORACLE_SQL is None; the tests hold run() against a brute-force version of each
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import decontaminate, langid, line_dedup, near_dedup, piece_sampling
from spanveil.llm.common import documents, few_rows, staged

#: Near-duplicates in the pipeline: five words a shingle, similarity 0.8 or more.
NEAR = {"words": 5, "num": 80, "den": 100}

#: Rows of an Arrow batch: five stages in one application leave little of an executor for Python.
ROWS = 512


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter at all) go; ambiguous ones, short or mixed, have one and stay."""
    few_rows(spark, ROWS)
    names = docs.columns
    tagged = langid.identify(docs, langid.fit(docs))
    return tagged.filter(F.col("lang_pred") != "und").select(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had nothing else has no text left and goes with them."""
    few_rows(spark, ROWS)
    names = docs.columns
    kept = line_dedup.dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id; of rows with one id, the one of the
    smallest text hash. Rows without an id all stay."""
    few_rows(spark, ROWS)
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), **NEAR)
    kept = docs.join(found.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = staged(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.xxhash64("text")).alias("least")).filter("rows > 1"), "repeated-ids")
    if not repeated.limit(1).count():
        return kept
    single = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    # Rows with one id and one text differ in other columns at most: the first of them in the order of all columns.
    rows = kept.join(repeated, kept["doc_id"] == repeated["doc_id"]).filter(F.xxhash64(kept["text"]) == repeated["least"])
    rows = rows.groupBy(kept["doc_id"]).agg(F.min(F.struct(*[kept[c] for c in docs.columns])).alias("row"))
    return single.unionByName(rows.select("row.*"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    few_rows(spark, ROWS)
    found = decontaminate.find_leaks(docs.select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    leaked = staged(found.select("doc_id").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids, and whether they spell the text again."""
    few_rows(spark, ROWS)
    both = piece_sampling.round_trip(docs, piece_sampling.Vocabulary.read(piece_sampling.MODEL))
    return both.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", leaks),
    ("sentencepiece", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
