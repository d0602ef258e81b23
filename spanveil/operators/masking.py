"""Rewriting texts: numbered aliases, or blocks of the same width."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import alias_label, bind, u16len, unit_slice, units_of, valid_span


def _rewritten(units: Column, n: Column, items: Column, put) -> Column:
    """The text with each item's span replaced: what lies before each item, and its replacement, joined once."""
    before = lambda i: F.when(i == 0, 0).otherwise(F.element_at(items, i)["stop"])
    parts = F.transform(items, lambda x, i: F.concat(unit_slice(units, before(i), x["start"]), put(x)))
    return F.concat(F.array_join(parts, ""), unit_slice(units, F.element_at(items, -1)["stop"], n))


def _masked(text: str, items: Callable[[Column, Column], Column], put) -> Column:
    """items(units, n) of the row replaced; a text without any as it is. Everything is worked out once a row."""
    done = bind(units_of(text), lambda u: bind(u16len(text), lambda n: bind(items(u, n), lambda x: F.when(F.size(x) > 0, _rewritten(u, n, x, put)))))
    return F.coalesce(F.when(F.size("_spans") > 0, done), F.col(text))


def united(items: Column, touching: bool) -> Column:
    """A row's spans, array<struct<ord,type,start,stop>>, as the union's islands: array<struct<start,stop,type>> in order.

    The first span of an island, by start, then the longest, then input order, gives the type.
    """
    island = "struct<start:int,stop:int,type:string>"
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), x["ord"].cast("int").alias("ord"), x["type"].alias("type"))))
    new = lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), x["type"].alias("type"))
    start = F.struct(F.expr(f"cast(array() AS array<{island}>)").alias("done"), F.expr(f"cast(null AS {island})").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        top = acc["open"]["stop"]
        apart = (x["start"] > top) if touching else (x["start"] >= top)
        grown = F.struct(acc["open"]["start"].alias("start"), F.greatest(top, -x["back"]).alias("stop"), acc["open"]["type"].alias("type"))
        return F.when(top.isNull(), F.struct(acc["done"].alias("done"), new(x).alias("open"))).when(apart, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), new(x).alias("open"))).otherwise(F.struct(acc["done"].alias("done"), grown.alias("open")))

    return F.aggregate(ordered, start, step, lambda acc: F.when(acc["open"]["stop"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def numbered(islands: Column, units: Column) -> Column:
    """Islands with their alias: numbered by type in order of first appearance of the covered text."""
    keyed = F.transform(islands, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.struct(x["type"].alias("type"), unit_slice(units, x["start"], x["stop"]).alias("value")).alias("key")))

    def named(own: Column, firsts: Column) -> Column:
        """A value's number is its place among the distinct ones of its type, in order of first appearance."""
        place = lambda x: F.size(F.filter(F.slice(firsts, F.lit(1), F.array_position(firsts, x["key"]).cast("int")), lambda k: k["type"] == x["key"]["type"]))
        return F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), alias_label(x["key"]["type"], place(x)).alias("alias")))

    return bind(keyed, lambda own: bind(F.array_distinct(F.transform(own, lambda x: x["key"])), lambda firsts: named(own, firsts)))


def gathered(texts: DataFrame, spans: DataFrame, keys: list[str], typed: bool) -> DataFrame:
    """texts with _spans: each one's own spans in an array; the texts are joined once."""
    kind = F.col("type") if typed else F.lit("")
    own = spans.groupBy(*keys).agg(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), kind.alias("type"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))).alias("_spans"))
    return texts.join(own, keys, "left")


def mask_aliases_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts, with an array _spans of struct<ord,type,start,stop>, with masked: everything within the row, nothing shuffled."""
    usable = lambda n: F.filter(F.col("_spans"), lambda x: valid_span(x["start"], x["stop"], n))
    items = lambda units, n: bind(united(usable(n), touching=False), lambda islands: numbered(islands, units))
    return texts.withColumn("masked", _masked(text, items, lambda x: x["alias"])).drop("_spans")


def mask_aliases(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """texts with masked: the union of the usable spans replaced by aliases. Texts without spans stay as they are."""
    return mask_aliases_of(gathered(texts, spans, keys, typed=True))


def mask_blocks_of(texts: DataFrame) -> DataFrame:
    """texts, with an array _spans of struct<ord,type,start,stop>, with masked: everything within the row, nothing shuffled."""
    items = lambda units, n: united(F.col("_spans"), touching=True)
    return texts.withColumn("masked", _masked("text", items, lambda x: F.repeat(F.lit(S.BLOCK), x["stop"] - x["start"]))).drop("_spans")


def mask_blocks(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """texts with masked: the union of the spans, touching ones merged, as blocks of the same UTF-16 width."""
    rows = gathered(texts, spans.withColumn("ord", F.lit(0)) if "ord" not in spans.columns else spans, keys, typed=False)
    return mask_blocks_of(rows)
