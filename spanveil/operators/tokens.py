"""Token pipeline: pre-tokens, chunk windows, BIO decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions.text import argmax, has_pairs, safe_boundary, softmax_of

#: One punctuation mark, or a run without white space and punctuation.
PRETOKEN = r"[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+"


def pretokens(text: str) -> Column:
    """array<string> of words and punctuation marks in order."""
    return F.regexp_extract_all(F.col(text), F.lit(PRETOKEN), F.lit(0))


def chunk_windows(n: Column | str, size: int = S.CHUNK_TOKENS, overlap: int = S.CHUNK_OVERLAP) -> Column:
    """Windows over n tokens, in closed form: the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    n, step = (F.col(n) if isinstance(n, str) else n), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    window = lambda k: F.struct(k.alias("chunk"), (k * step).alias("token_start"), F.least(k * step + size, n).cast("int").alias("token_stop"), (k > 0).alias("has_previous"), (k < last).alias("has_next"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.expr("cast(array() AS array<struct<chunk:int,token_start:int,token_stop:int,has_previous:boolean,has_next:boolean>>)"))


def wrapped(tokens: str, first: int, last: int) -> Column:
    """A chunk's tokens between the model's start and end tokens."""
    special = lambda i: F.expr(f"array(cast(named_struct('id', {i}, 'start', 0, 'stop', 0, 'attn', 1, 'special', 1) AS {S.TOKEN}))")
    return F.concat(special(first), F.col(tokens), special(last))


def tokens_are_sound(tokens: str, length: str) -> Column:
    """Ids at least 0, masks 0 or 1, offsets in order and inside the text."""
    return F.forall(tokens, lambda t: (t["id"] >= 0) & t["attn"].isin(0, 1) & t["special"].isin(0, 1) & (t["start"] >= 0) & (t["start"] <= t["stop"]) & (t["stop"] <= F.col(length)))


def input_is_sound(ids: Column | str, mask: Column | str, most: int = S.MAX_TOKENS, vocabulary: int = S.VOCABULARY) -> Column:
    """Whether a model may take a chunk: 1 to most ids of the vocabulary, and a mask of as many zeros and ones."""
    ids, mask = (F.col(c) if isinstance(c, str) else c for c in (ids, mask))
    return F.coalesce(F.size(ids).between(1, most) & (F.size(mask) == F.size(ids)) & F.forall(ids, lambda i: (i >= 0) & (i < vocabulary)) & F.forall(mask, lambda m: m.isin(0, 1)), F.lit(False))


def label_of(labels: list[str], place: Column) -> Column:
    """The label at a place; labels must be O and B-/I- of the known types."""
    for x in labels:
        if x != "O" and (x[:2] not in ("B-", "I-") or x[2:] not in S.PII_TYPES):
            raise ValueError(f"unsupported label {x}")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), place + 1)


def decode_bio(tokens: DataFrame, labels: list[str], keys: list[str], texts: DataFrame) -> DataFrame:
    """Entities of each chunk.

    tokens: keys, chunk, i, start, stop, attn, special, logits, has_previous, has_next, token_start; texts: keys, text.
    Tokens carry offsets only. Bounds within a pair are moved off it afterwards, which needs only the texts with pairs. An entity starts at B, and at I after anything else than its own type; what is special, masked or
    empty ends one. Confidence is the mean of the tokens' softmax shares.
    """
    place = argmax("logits")
    rows = tokens.withColumn("label", label_of(labels, place)).withColumn("p", softmax_of("logits", len(labels)))
    content = (F.col("special") == 0) & (F.col("attn") == 1) & (F.col("stop") > F.col("start"))
    rows = rows.withColumn("content", content).withColumn("kind", F.when(content & (F.col("label") != "O"), F.substring("label", 3, 100)))
    w = Window.partitionBy(*keys, "chunk").orderBy("i")
    whole = Window.partitionBy(*keys, "chunk")
    new = F.col("kind").isNotNull() & (F.col("label").startswith("B-") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)))
    rows = rows.withColumn("new", new)
    # One sort serves all of these.
    rows = rows.select(
        "*",
        F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("entity"),
        (F.sum(F.when(F.col("special") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1 + F.col("token_start")).alias("token_index"),
        F.min(F.when(F.col("content"), F.col("i"))).over(whole).alias("first"),
        F.max(F.when(F.col("content"), F.col("i"))).over(whole).alias("last"),
    ).filter(F.col("kind").isNotNull())
    found = rows.groupBy(*keys, "chunk", "entity").agg(
        F.first("kind").alias("type"),
        F.avg("p").alias("confidence"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.bool_or(F.col("has_previous") & (F.col("i") == F.col("first"))).alias("truncated_start"),
        F.bool_or(F.col("has_next") & (F.col("i") == F.col("last"))).alias("truncated_stop"),
        F.sort_array(F.collect_list(F.struct("token_index", F.col("p").alias("confidence")))).alias("tokens"),
    )
    paired = texts.filter(has_pairs("text")).select(*keys, "text")
    return found.join(paired, keys, "left").withColumns({"start": F.when(F.col("text").isNull(), F.col("start")).otherwise(safe_boundary("text", "start", False)), "stop": F.when(F.col("text").isNull(), F.col("stop")).otherwise(safe_boundary("text", "stop", True))}).drop("text")
