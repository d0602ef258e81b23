"""Reviewed decisions against the detections they were made on; documents pass whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions.text import bind, u16len, unit_slice, unit_splits, units_of, valid_span
from .policy import with_policy
from .spans import union_spans


def request(segments: DataFrame, detections: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """Detections with word and policy, and whether each is acceptable: known type, confidence, span, and seen once.

    A segment's detections are gathered, so its text meets them once; one shuffle serves the count and the gathering.
    """
    where = ["doc_id", "segment_id"]
    same = Window.partitionBy(*where).orderBy("type", "start", "stop").rangeBetween(Window.currentRow, Window.currentRow)
    rest = [c for c in detections.columns if c not in where]
    counted = detections.withColumn("_times", F.count(F.lit(1)).over(same))
    own = counted.groupBy(*where).agg(F.collect_list(F.struct(*rest, "_times")).alias("_own"))
    joined = own.join(segments.select(*where, "text"), where, "left")

    def checked(units: Column, n: Column) -> Column:
        def one(x: Column) -> Column:
            sound = x["type"].isin(S.PII_TYPES) & x["confidence"].between(0, 1) & ~F.isnan(x["confidence"]) & valid_span(x["start"], x["stop"], n) & ~unit_splits(units, x["start"]) & ~unit_splits(units, x["stop"])
            ok = F.coalesce(F.col("text").isNotNull() & sound & (x["_times"] == 1), F.lit(False))
            return F.struct(*[x[c].alias(c) for c in rest], ok.alias("sound"), F.when(ok, unit_slice(units, x["start"], x["stop"])).alias("word"))

        return F.transform("_own", one)

    rows = joined.select(*where, F.inline(bind(units_of("text"), lambda units: bind(u16len("text"), lambda n: checked(units, n)))))
    return with_policy(rows, preferences)


def rejected_segments(segments: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Documents in which a segment id stands twice; with results(doc_id, segment_id), a row for each segment that was
    scanned, also those with a segment without exactly one result, or a result without a segment."""
    asked = segments.select("doc_id", "segment_id", F.lit(1).alias("a"), F.lit(0).alias("r"))
    both = asked if results is None else asked.unionByName(results.select("doc_id", "segment_id", F.lit(0).alias("a"), F.lit(1).alias("r")))
    counted = both.groupBy("doc_id", "segment_id").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    bad = (F.col("a") != 1) if results is None else (F.col("a") != 1) | (F.col("r") != 1)
    return counted.filter(bad).select("doc_id").distinct()


def resolve(asked: DataFrame, decisions: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(masks, rejects): masks has a row for every segment of a document that passes, with its merged spans.

    decisions: doc_id, status, grp, segment_id, type, start, stop, word. Every decision must meet one
    detection of its own, with its word and, if it masks, in the group of its policy; none may be left over.
    A cancelled document has neither masks nor a reject.
    """
    keys = ["doc_id", "segment_id", "type", "start", "stop"]
    wanted = F.when(F.col("policy") == S.AUTO, "autoMask").otherwise("confirm_masking")
    made = decisions.filter(F.col("status") == "approved").groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("times"), F.min("grp").alias("grp"))
    asked = asked.select(*keys, F.col("word").alias("own_word"), "policy", "sound", F.lit(True).alias("known"))
    both = asked.join(made, keys, "full")
    fits = F.col("known") & F.col("sound") & (F.col("times") == 1) & (F.col("word") == F.col("own_word")) & ((F.col("grp") == "nonMasking") | (F.col("grp") == wanted))
    # A document counts if a decision approves it: known from its own rows, without asking the decisions again.
    whole = Window.partitionBy("doc_id")
    checked = both.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("approved", F.max(F.col("times").isNotNull()).over(whole)).withColumn("ok", F.min("fits").over(whole)).filter("approved")
    documents = checked.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"))
    rejects = documents.filter(~F.col("ok")).select("doc_id", F.lit("reviewing").alias("stage"), F.lit(S.ERROR_DEFAULT).alias("code"))
    passed = documents.filter("ok").select("doc_id")
    chosen = checked.filter(F.col("ok") & F.col("grp").isin("autoMask", "confirm_masking")).withColumn("ord", F.lit(0))
    merged = union_spans(chosen, ["doc_id", "segment_id"], touching=True).groupBy("doc_id", "segment_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    every = segments.join(passed, "doc_id", "left_semi").select("doc_id", "segment_id")
    masks = every.join(merged, ["doc_id", "segment_id"], "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() AS array<struct<start:int,stop:int>>)")))
    return masks, rejects
