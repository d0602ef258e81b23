"""Requests, answers and what binds them: envelopes as JSON, answers against requests, staleness, versions, references."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S

# Fixed values of the envelopes; the channel's name is the caller's.
CHANNEL = "pii:v1"
TARGETS = ["background", "offscreen", "worker"]
LONGEST_TIMEOUT = 2_147_483_647
ERRORS = ["MODEL_NOT_READY", "MODEL_DOWNLOAD_FAILED", "MODEL_LOAD_FAILED", "INFERENCE_FAILED", "OUT_OF_MEMORY", "INVALID_INPUT", "CANCELLED"]


def kind_at(message: Column, path: str) -> Column:
    """The JSON type at a path of a variant: null if nothing is there."""
    return F.schema_of_variant(F.try_variant_get(message, path, "variant"))


def text_at(message: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    return F.when(kind_at(message, path) == "STRING", F.try_variant_get(message, path, "string"))


def number_at(message: Column, path: str) -> Column:
    return F.when(kind_at(message, path).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(message, path, "double"))


def _named(message: Column, *paths: str) -> Column:
    """Strings that are not empty."""
    return F.forall(F.array(*[F.coalesce(F.length(text_at(message, p)), F.lit(0)) for p in paths]), lambda n: n > 0)


def _absent_or(message: Column, path: str, valid: Column) -> Column:
    return kind_at(message, path).isNull() | F.coalesce(valid, F.lit(False))


def is_cancel(json: Column | str, target: str, channel: str = CHANNEL) -> Column:
    """Whether a text is the cancel message of a target."""
    m = F.try_parse_json(json)
    own = (text_at(m, "$.channel") == channel) & (text_at(m, "$.target") == target) & (text_at(m, "$.type") == "pii:cancel")
    return F.coalesce(own & _named(m, "$.clientId", "$.requestId") & _absent_or(m, "$.ownerKey", text_at(m, "$.ownerKey").isNotNull()), F.lit(False))


def is_request(json: Column | str, target: str | None = None, channel: str = CHANNEL) -> Column:
    """Whether a text is a request: of a known target, with its names, a timeout in range, and what its type needs."""
    m = F.try_parse_json(json)
    wait = number_at(m, "$.requestTimeoutMs")
    segments = F.try_variant_get(m, "$.segments", "array<variant>")
    texts = F.forall(segments, lambda s: text_at(s, "$.id").isNotNull() & text_at(s, "$.text").isNotNull())
    kind = text_at(m, "$.type")
    what = (kind == "pii:init") | ((kind == "pii:scan-text") & text_at(m, "$.text").isNotNull()) | ((kind == "pii:scan-segments") & F.coalesce(texts, F.lit(False)))
    addressed = text_at(m, "$.target").isin(TARGETS) if target is None else text_at(m, "$.target") == target
    own = (text_at(m, "$.channel") == channel) & addressed & _named(m, "$.requestId", "$.clientId")
    sound = _absent_or(m, "$.ownerKey", text_at(m, "$.ownerKey").isNotNull()) & _absent_or(m, "$.requestTimeoutMs", (wait > 0) & (wait <= LONGEST_TIMEOUT))
    return F.coalesce(own & sound & what, F.lit(False))


def is_status(json: Column | str) -> Column:
    """Whether a text is a detector's status."""
    m = F.try_parse_json(json)
    state = text_at(m, "$.state")
    found = (
        state.isin("idle", "loading")
        | ((state == "downloading") & F.coalesce(number_at(m, "$.progress").between(0, 1), F.lit(False)))
        | ((state == "ready") & F.coalesce(text_at(m, "$.backend").isin("webgpu", "wasm"), F.lit(False)))
        | ((state == "error") & text_at(m, "$.message").isNotNull())
    )
    return F.coalesce(found, F.lit(False))


def owner_key(sender: str, context: str, tab: str, frame: str, document: str, url: str) -> Column:
    """Who owns a request; a page's address counts only where neither its context nor its document has an id."""
    own = F.when(F.coalesce(context, document).isNull(), F.col(url))
    return F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (sender, context, tab, frame, document)], F.coalesce(own, F.lit(""))))


def answered(requests: DataFrame, answers: DataFrame, key: str = "request") -> DataFrame:
    """(key, valid): requests(key, ord, segment_id, n) against answers(key, ord, segment_id, sound): one answer for each
    segment, at its place, with its id and sound detections; one that is missing, moved or too much fails the whole request."""
    asked = requests.select(key, "ord", F.col("segment_id").alias("own_id"), F.lit(True).alias("asked"))
    given = answers.groupBy(key, "ord").agg(F.count(F.lit(1)).alias("times"), F.min("segment_id").alias("segment_id"), F.bool_and("sound").alias("sound"))
    fits = F.col("asked") & (F.col("times") == 1) & (F.col("segment_id") == F.col("own_id")) & F.col("sound")
    return asked.join(given, [key, "ord"], "full").groupBy(key).agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("valid"))


def error_envelope(request: Column | str, code: Column | str, message: Column | str, fallback: str = "INFERENCE_FAILED", channel: str = CHANNEL) -> Column:
    """A failure as the JSON that leaves the library: a known code with its message, anything else as the fallback without one."""
    code, message = (F.col(c) if isinstance(c, str) else c for c in (code, message))
    known = F.coalesce(code.isin(ERRORS), F.lit(False))
    error = F.struct(F.when(known, code).otherwise(fallback).alias("code"), F.when(known, F.coalesce(message, F.lit(""))).otherwise("PII request failed.").alias("message"))
    return F.to_json(F.struct(F.lit(channel).alias("channel"), F.col(request).alias("requestId") if isinstance(request, str) else request.alias("requestId"), F.lit("pii:error").alias("type"), error.alias("error")))


def still_current(results: DataFrame, states: DataFrame, bound: list[str], key: str = "request") -> DataFrame:
    """Results that still stand: what they are bound to (address, text, conversation) is as it was, nulls included."""
    s = states.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in bound])
    same = F.lit(True)
    for c in bound:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return results.join(s, (F.col(key) == F.col("_key")) & same, "left_semi")


def as_of(requests: DataFrame, versions: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """requests(key, ts, ...) with the value of the last version(key, ts, value) at or before them; one sort of both, no range join."""
    rest = [c for c in requests.columns if c not in (key, ts)]
    both = requests.select(key, ts, F.lit(1).alias("_r"), F.struct(*rest).alias("_row"), F.lit(None).cast(versions.schema[value].dataType).alias("_v"))
    both = both.unionByName(versions.select(key, ts, F.lit(0).alias("_r"), F.col(value).alias("_v")), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(ts, "_r").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).filter("_r = 1").select(key, ts, "_row.*", value)


def substituted(items: DataFrame, replacements: DataFrame, key: str, value: str) -> DataFrame:
    """items with the replacement of their value where there is one."""
    r = replacements.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_there"))
    out = items.join(r, F.col(key) == F.col("_key"), "left").withColumn(value, F.when(F.col("_there"), F.col("_value")).otherwise(F.col(value)))
    return out.drop("_key", "_value", "_there")


def opaque_ids(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """rows with opaque: names numbered from 0 by their first appearance."""
    first = F.min(order).over(Window.partitionBy(*keys, name))
    return rows.withColumn("_first", first).withColumn("opaque", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")) - 1).drop("_first")


def in_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """Review items as they are listed: by start, then stop, then input order."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "stop", "ord")))


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str], most_steps: int = 1000) -> DataFrame:
    """(keys, node): what edges(keys, source, target) reach from roots(keys, node), these included.

    Each step joins only the nodes that the one before it found, and its result is cut from the plan in spark.checkpoint.dir;
    only local mode does without that setting, in a folder of its own.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spanveil-"))
    cut = lambda df: df.checkpoint()
    steps = edges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("source").alias("_source"), "target")
    found = new = cut(roots.select(*keys, "node").distinct())
    for _ in range(most_steps):
        on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("node") == F.col("_source")]
        ahead = new.join(steps, on).select(*keys, F.col("target").alias("node")).distinct()
        new = cut(ahead.join(found, [*keys, "node"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    raise RuntimeError("more steps than allowed")
