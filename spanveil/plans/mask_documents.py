"""Whole flows: find, decide, mask. What fails leaves a reject row and no output, never the original."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import detect, masking, policy, review
from ..sources import office, pdf, textfile

KEYS = ["doc_id", "segment_id"]
Detector = Callable[[DataFrame, list[str]], DataFrame]


def mask_text(segments: DataFrame, keys: list[str], detector: Detector = detect.by_rules, preferences: DataFrame | None = None) -> DataFrame:
    """Chat texts with what is masked without asking replaced by aliases; texts without findings as they are."""
    found = policy.with_policy(detector(segments, keys), preferences)
    return masking.mask_aliases(segments, found.filter(F.col("policy") == S.AUTO).drop("policy"), keys)


def approve_automatic(asked: DataFrame) -> DataFrame:
    """The decision of a reviewer who keeps the default: automatic types masked, the others not."""
    grp = F.when(F.col("policy") == S.AUTO, "autoMask").otherwise("nonMasking")
    return asked.select("doc_id", F.lit("approved").alias("status"), grp.alias("grp"), "segment_id", "type", "start", "stop", "word")


def _masks(segments: DataFrame, detector: Detector, reviewer, preferences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    twice = review.rejected_segments(segments)
    segments = segments.join(twice, "doc_id", "left_anti")
    asked = review.request(segments, detector(segments, KEYS), preferences)
    masks, rejects = review.resolve(asked, reviewer(asked), segments)
    clean = segments.join(asked.select("doc_id").distinct(), "doc_id", "left_anti").select(*KEYS, F.expr("cast(array() AS array<struct<start:int,stop:int>>)").alias("spans"))
    failed = twice.select("doc_id", F.lit("reviewing").alias("stage"), F.lit(S.ERROR_DEFAULT).alias("code"))
    return masks.select(*KEYS, "spans").unionByName(clean), rejects.unionByName(failed)


def mask_office(files: DataFrame, kind: str, detector: Detector = detect.by_rules, reviewer=approve_automatic, preferences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, content) of DOCX or HWPX to masked files and rejects."""
    segments, refused = office.segments(files, kind)
    masks, unresolved = _masks(segments, detector, reviewer, preferences)
    done, failed = office.rebuild(files, masks, kind)
    return done, refused.unionByName(unresolved).unionByName(failed)


def mask_pdf(files: DataFrame, open_pdf: Callable, detector: Detector = detect.by_rules, reviewer=approve_automatic, preferences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, content) of PDFs to pages with the text that is kept, and rejects; the reader and the writing are the caller's."""
    pages, refused = pdf.segments(files, open_pdf)
    masks, unresolved = _masks(pages.select(*KEYS, "text"), detector, reviewer, preferences)
    passed = pages.join(masks.select(*KEYS), KEYS, "left_semi")
    done, failed = pdf.kept_text(passed, masks)
    return done, refused.unionByName(unresolved).unionByName(failed)


def mask_text_files(files: DataFrame, detector: Detector = detect.by_rules, reviewer=approve_automatic, preferences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, name, length, content) of text and Markdown to masked files and rejects."""
    good, refused = textfile.scan(files)
    masks, unresolved = _masks(good.select(*KEYS, "text"), detector, reviewer, preferences)
    spans = masks.select(*KEYS, F.inline("spans")).withColumn("ord", F.lit(0)).withColumn("type", F.lit("SECRET"))
    passed = good.join(masks.select(*KEYS), KEYS, "left_semi")
    done, large = textfile.output(masking.mask_blocks(passed, spans, KEYS))
    return done, refused.unionByName(unresolved).unionByName(large)


def outcomes(files: DataFrame, done: DataFrame, kinds: list[str], batch: str, unhandled: str = "hold") -> DataFrame:
    """(files, outcome): files(doc_id, kind, batch) against done(doc_id, ok) of those that a processor took.

    A file without a processor is held, or passed on as it is. Of a batch goes all or nothing: what would have gone out
    waits with the batch if one of its files is held, cancelled or failed.
    """
    if unhandled not in ("hold", "pass"):
        raise ValueError("unhandled files are held or passed")
    own = done.groupBy("doc_id").agg(F.bool_and("ok").alias("_ok"))
    alone = F.when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "unhandled" if unhandled == "hold" else "passed").when(F.coalesce("_ok", F.lit(False)), "masked").otherwise("cancelled")
    each = files.join(own, "doc_id", "left").withColumn("outcome", alone).drop("_ok")
    # Counted by batch and joined: a batch of any number of files is no window of one task.
    bad = each.filter(F.col("outcome").isin("unhandled", "cancelled")).select(batch).distinct().withColumn("_bad", F.lit(True))
    goes = each.join(bad, batch, "left").withColumn("outcome", F.when(F.col("_bad") & F.col("outcome").isin("masked", "passed"), "waits").otherwise(F.col("outcome")))
    return goes.drop("_bad")


#: Kinds with a processor; others pass or are held by the caller's policy.
def processors(open_pdf: Callable | None = None) -> dict[str, Callable]:
    """The processor of each kind; PDFs have one where the caller brings a reader."""
    return PROCESSORS | ({"pdf": lambda f, **k: mask_pdf(f, open_pdf, **k)} if open_pdf else {})


PROCESSORS = {"docx": lambda f, **k: mask_office(f, "docx", **k), "hwpx": lambda f, **k: mask_office(f, "hwpx", **k), "text": mask_text_files}

