"""Detections of overlapping chunks to one set, in SQL functions.

Views agree, continue or conflict only where they overlap, so runs of overlapping candidates are independent; all of them
are settled at once, each in its own row. Within a run the best-ranked candidate that is left settles next: it is one
more view of a settled entity, its continuation, or a new entity. A run holds the candidates of one stretch of text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import islands, regions

NEAR = 0.8
ENTITY = "struct<type:string,confidence:double,start:int,stop:int,from_before:boolean,goes_on:boolean,chunk:int,chunks:array<int>,tokens:array<struct<key:int,value:double>>>"

# e is a settled entity, n the next candidate.
SHARED = "(least(e.stop, n.stop) - greatest(e.start, n.start))"
EXTENT = "(greatest(e.stop, n.stop) - least(e.start, n.start))"


def _explained(x: str, y: str) -> str:
    """x is a cut view of y: it lies inside, and what it misses of y is behind a cut."""
    return f"({x}.start >= {y}.start AND {x}.stop <= {y}.stop AND ({x}.from_before OR {x}.goes_on) AND ({x}.from_before OR {x}.start = {y}.start) AND ({x}.goes_on OR {x}.stop = {y}.stop))"


def _carries_on(x: str, y: str) -> str:
    """y runs out at its chunk's end, and x comes in at its chunk's start with a part of y."""
    return f"(y_x.goes_on AND x_y.from_before AND y_x.start < x_y.start AND x_y.start < y_x.stop AND y_x.stop < x_y.stop)".replace("y_x", y).replace("x_y", x)


ELSEWHERE = "NOT array_contains(e.chunks, n.chunk) AND e.type = n.type"
SAME = f"({ELSEWHERE} AND {SHARED} > 0 AND ({SHARED} > {NEAR}D * {EXTENT} OR {_explained('e', 'n')} OR {_explained('n', 'e')}))"
#: Nothing else of the chunks concerned lies in what the two cover together.
FREE = "size(filter(kept, (x, j) -> j <> i AND arrays_overlap(x.chunks, array_append(e.chunks, n.chunk)) AND x.start < greatest(e.stop, n.stop) AND x.stop > least(e.start, n.start))) = 0"
JOINS = f"({ELSEWHERE} AND ({_carries_on('n', 'e')} OR {_carries_on('e', 'n')}) AND {FREE})"
VIEWED = f"""cast(named_struct('type', e.type, 'confidence', if(e.start = n.start AND e.stop = n.stop, greatest(e.confidence, n.confidence), e.confidence),
    'start', least(e.start, n.start), 'stop', greatest(e.stop, n.stop), 'from_before', if(n.start < e.start, n.from_before, e.from_before), 'goes_on', if(n.stop > e.stop, n.goes_on, e.goes_on),
    'chunk', e.chunk, 'chunks', array_append(e.chunks, n.chunk), 'tokens', e.tokens) AS {ENTITY})"""
TOKENS = "map_entries(map_zip_with(map_from_entries(e.tokens), map_from_entries(n.tokens), (k, a, b) -> greatest(coalesce(a, 0D), coalesce(b, 0D))))"
BOTH = f"""element_at(transform(array(if(size(e.tokens) > 0 AND size(n.tokens) > 0, {TOKENS}, NULL)), t ->
    cast(named_struct('type', e.type, 'confidence', coalesce(aggregate(t, 0D, (s, x) -> s + x.value) / size(t), (e.confidence + n.confidence) / 2),
    'start', least(e.start, n.start), 'stop', greatest(e.stop, n.stop), 'from_before', if(n.start < e.start, n.from_before, e.from_before), 'goes_on', if(n.stop > e.stop, n.goes_on, e.goes_on),
    'chunk', e.chunk, 'chunks', array_append(e.chunks, n.chunk), 'tokens', coalesce(t, e.tokens)) AS {ENTITY})), 1)"""


def _where(condition: str) -> str:
    """The place of the first settled entity of which it holds, from 1; else 0."""
    return f"coalesce(array_position(transform(kept, (e, i) -> {condition}), true), 0)"


def _bound(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


STEP = _bound("t", _where(SAME), f"""CASE WHEN t > 0 THEN transform(kept, (e, i) -> if(i = t - 1, {VIEWED}, e))
    ELSE {_bound("c", _where(JOINS), f"if(c > 0, transform(kept, (e, i) -> if(i = c - 1, {BOTH}, e)), array_append(kept, n))")} END""")
SETTLED = f"aggregate(transform(array_sort(members), m -> m.view), cast(array() AS array<{ENTITY}>), (kept, n) -> {STEP})"


def merge_chunks(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Merged views of each run of overlapping candidates."""
    cut = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("truncated_start", "truncated_stop")}
    clipped, length = cut["truncated_start"] | cut["truncated_stop"], F.col("stop") - F.col("start")
    tokens = F.transform("tokens", lambda t: F.struct(t["token_index"].cast("int").alias("key"), t["confidence"].cast("double").alias("value")))
    view = F.struct(
        "type", F.col("confidence").cast("double").alias("confidence"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"),
        cut["truncated_start"].alias("from_before"), cut["truncated_stop"].alias("goes_on"), F.col("chunk").cast("int").alias("chunk"), F.array(F.col("chunk").cast("int")).alias("chunks"), tokens.alias("tokens"),
    ).cast(ENTITY)
    rank = F.struct(clipped.alias("a"), F.when(clipped, -length.cast("double")).otherwise(-F.col("confidence")).alias("b"), (-length).alias("c"), (-F.col("confidence")).alias("d"), F.col("chunk").alias("e"), F.col("ord").alias("f"))
    runs = islands(candidates, keys, False, [F.col("start"), F.col("stop"), F.col("ord")])
    runs = runs.select(*keys, "island", "chunk", F.struct(rank.alias("rank"), view.alias("view")).alias("member")).groupBy(*keys, "island")
    runs = runs.agg(F.collect_list("member").alias("members"), (F.min("chunk") == F.max("chunk")).alias("alone"))
    settled = F.when(F.col("alone"), F.transform("members", lambda m: m["view"])).otherwise(F.expr(SETTLED))
    out = runs.select(*keys, F.inline(settled))
    return out.select(*keys, "type", "confidence", "start", "stop", "chunk", (F.col("from_before") | F.col("goes_on")).alias("clipped"))


def reconcile(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, ord, type, confidence, start, stop, chunk, truncated_start, truncated_stop, tokens) to disjoint regions."""
    if "tokens" not in candidates.columns:
        candidates = candidates.withColumn("tokens", F.lit(None).cast("array<struct<token_index:int,confidence:double>>"))
    return regions(merge_chunks(candidates, keys), keys)
