"""Detectors: rules in SQL functions, or rows that were found before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our own rules; order gives the input order of detections at one place.
RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    ("PHONE", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.9),
    ("CARD_NUMBER", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0.85),
    ("RRN", r"[0-9]{6}-[1-4][0-9]{6}", 0.9),
    ("SECRET", r"AKIA[A-Z0-9]{16}|(?:password|token|secret) ?[:=] ?\"?[0-9A-Za-z]{16,}", 0.8),
    ("GENERIC_ID", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.6),
]


def positions(text: str, pattern: str) -> Column:
    """array<struct<start,stop>> of all matches in UTF-16 units: the lengths of what lies between them add up."""
    t = F.col(text)
    units = lambda x: F.length(x) + F.length(F.regexp_replace(x, "[^\\x{10000}-\\x{10FFFF}]", ""))
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found))
    none = F.expr("cast(array() AS array<struct<start:int,stop:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["m"]
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop")))).alias("found"))

    parts = F.zip_with(gaps, found, lambda g, m: F.struct(units(g).alias("gap"), units(m).alias("m")))
    return F.when(t.rlike(pattern), F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a["found"])).otherwise(none)


def rule_spans(text: str) -> Column:
    """array<struct<ord,type,confidence,start,stop>> of all rules' matches, rule by rule."""

    def found(i: int, kind: str, pattern: str, confidence: float) -> Column:
        return F.transform(positions(text, pattern), lambda x: F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), x["start"].alias("start"), x["stop"].alias("stop")))

    return F.concat(*[found(i, *rule) for i, rule in enumerate(RULES)])


def by_rules(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, ord, type, confidence, start, stop; one pass over the texts, nothing shuffled."""
    return segments.filter(F.length(text) > 0).select(*keys, F.inline(rule_spans(text)))
