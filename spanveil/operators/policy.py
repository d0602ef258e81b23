"""Masking policies, reviews and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .spans import expand, keep_first, usable


def defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, S.default_policy(k)) for k in S.PII_TYPES], "type string, policy string")


def normalised(preferences: DataFrame, spark: SparkSession) -> DataFrame:
    """All types with a policy: the stored one if it is one, else the default; unknown types fall away, so 18 rows at most are sent."""
    sound = preferences.filter(F.col("type").isin(S.PII_TYPES) & F.col("policy").isin(S.AUTO, S.CONFIRM))
    stored = sound.groupBy("type").agg(F.min("policy").alias("stored"))  # of several, masking wins
    return defaults(spark).join(F.broadcast(stored), "type", "left").select("type", F.coalesce("stored", "policy").alias("policy"))


def policy_of(kind: str = "type"):
    return F.when(F.col(kind).isin(S.AUTO_MASKED), S.AUTO).otherwise(S.CONFIRM)


def with_policy(rows: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """rows with the policy of their type: a user's normalised preferences (18 rows, sent to all tasks), or else the default."""
    if preferences is None:
        return rows.withColumn("policy", policy_of())
    own = preferences.select(F.col("type").alias("_type"), F.col("policy").alias("_policy"))
    joined = rows.join(F.broadcast(own), F.col("type") == F.col("_type"), "left")
    return joined.withColumn("policy", F.coalesce("_policy", policy_of())).drop("_type", "_policy")


def analyse(detections: DataFrame, keys: list[str], length: str = "n", preferences: DataFrame | None = None) -> DataFrame:
    """Constituents with a usable span, the first of equal ones, each with its policy."""
    rows = expand(detections) if "constituents" in detections.columns else detections
    return with_policy(keep_first(usable(rows, length), keys), preferences)


def review(analysed: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Selected or not: decisions(keys, type, start, stop, selected) over the default, which selects what is automatic."""
    on = [*keys, "type", "start", "stop"]
    joined = analysed.join(decisions.select(*on, "selected"), on, "left")
    chosen = F.coalesce("selected", F.col("policy") == S.AUTO)
    group = F.when(~chosen, "nonMasking").when(F.col("policy") == S.AUTO, "autoMask").otherwise("confirm_masking")
    return joined.withColumn("grp", group).drop("selected")


def summary(detections: DataFrame, keys: list[str]) -> DataFrame:
    return detections.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def selection(reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """How many are selected of all, and whether none, some or all."""
    picked = F.count_if(F.col("grp") != "nonMasking")
    return reviewed.groupBy(*keys).agg(picked.alias("selected"), F.count(F.lit(1)).alias("total"), F.when(picked == 0, "none").when(picked == F.count(F.lit(1)), "all").otherwise("some").alias("state"))


def all_or_nothing(files: DataFrame, batch: str, ok: str) -> DataFrame:
    """Files of the batches in which every one passed."""
    failed = files.filter(~F.coalesce(F.col(ok), F.lit(False))).select(batch).distinct()
    return files.join(failed, batch, "left_anti")


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last event: a maximum with map-side combine instead of a sorted window."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")

