"""Span algebra: windows per segment, no self-joins where a running maximum does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions.text import u16len, valid_span


def expand(regions: DataFrame) -> DataFrame:
    """Regions to their constituents, or to themselves where they have none."""
    own = F.array(F.struct("type", "confidence", "start", "stop"))
    rest = [c for c in regions.columns if c not in ("type", "confidence", "start", "stop", "constituents")]
    return regions.select(*rest, F.inline(F.coalesce("constituents", own)))


def keep_first(spans: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first of equal (type, start, stop) in input order."""
    w = Window.partitionBy(*keys, "type", "start", "stop").orderBy(order)
    return spans.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def islands(spans: DataFrame, keys: list[str], touching: bool, order: list | None = None) -> DataFrame:
    """spans with island: numbered runs that overlap (or, if touching, at least touch) what lies before them.

    A span is compared with the greatest stop so far, so contained spans don't end a run.
    """
    order = order or [F.col("start"), F.col("stop").desc(), F.col("ord")]
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("start") > before) if touching else (F.col("start") >= before)
    return spans.withColumn("_new", F.when(before.isNull() | apart, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def union_spans(spans: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """Each island's extent, with the type of its first span: least start, then longest, then input order."""
    first = F.min_by("type", F.struct("start", -F.col("stop"), "ord")).alias("type")
    return islands(spans, keys, touching).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), first, F.count(F.lit(1)).alias("members"))


def regions(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap regions: the best-ranked member names them, more than one member are kept as constituents.

    Rank: not clipped, confidence, length, start, type, chunk.
    """
    clipped = F.col("clipped").cast("int")
    rank = F.struct(clipped, -F.col("confidence"), F.col("start") - F.col("stop"), "start", "type", "chunk")
    member = F.struct("start", "stop", rank.alias("rank"), "type", "confidence")
    grouped = islands(candidates, keys, False, [F.col("start"), F.col("stop"), rank]).groupBy(*keys, "island")
    out = grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by(F.struct("type", "confidence"), rank).alias("best"), F.array_sort(F.collect_list(member)).alias("members"))
    constituents = F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["confidence"].alias("confidence"), m["start"].alias("start"), m["stop"].alias("stop")))
    return out.select(*keys, F.col("best.type").alias("type"), F.col("best.confidence").alias("confidence"), "start", "stop", F.when(F.size("members") > 1, constituents).alias("constituents"))


def region_is_sound(constituents: str = "constituents"):
    """Two or more members of known types, inside the region, each overlapping those that start before it, covering it exactly."""
    types = ", ".join(f"'{x}'" for x in S.PII_TYPES)
    sound = F.expr(
        f"""aggregate(array_sort({constituents}, (x, y) -> CASE WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 ELSE 0 END),
            named_struct('ok', size({constituents}) >= 2, 'top', cast(null AS int)),
            (a, m) -> named_struct('ok', a.ok AND coalesce(m.type IN ({types}) AND m.start >= start AND m.stop <= stop AND m.stop > m.start AND m.confidence BETWEEN 0 AND 1
                                         AND (a.top IS NULL AND m.start = start OR m.start < a.top), false),
                                   'top', greatest(coalesce(a.top, m.stop), m.stop)),
            a -> a.ok AND a.top = stop)"""
    )
    return F.when(F.col(constituents).isNull(), F.lit(True)).otherwise(sound)


def overlap_join(spans: DataFrame, pieces: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Masks on text pieces: half-open overlap, clipped to the piece.

    Both sides are dealt to buckets of offsets, so a long document is split and meets only what lies near. A pair meets in
    the bucket where the later of the two starts, and nowhere else.
    """
    home = lambda c: F.floor(c / F.lit(width)).cast("long")
    deal = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(home(F.col(a)), home(F.greatest(F.col(a), F.col(b) - 1)))))
    s, p = deal(spans, "start", "stop").alias("s"), deal(pieces, "piece_start", "piece_stop").alias("p")
    on = [F.col(f"s.{k}") == F.col(f"p.{k}") for k in [*keys, "_bucket"]] + [F.col("s.start") < F.col("p.piece_stop"), F.col("p.piece_start") < F.col("s.stop")]
    later = F.greatest("s.start", "p.piece_start")
    kept = [F.col(f"p.{c}") for c in pieces.columns]
    return s.join(p, [*on, home(later) == F.col("s._bucket")]).select(*kept, later.alias("start"), F.least("s.stop", "p.piece_stop").alias("stop"))


def fragments(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Texts cut at every span boundary, each fragment with how many spans cover it."""
    # A sweep: +1 where a span starts, -1 where it stops; the running sum is the cover.
    ends = texts.select(*keys, F.explode(F.array(F.lit(0), u16len("text"))).alias("at"), F.lit(0).alias("d"))
    marks = spans.select(*keys, F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("stop").alias("at"), F.lit(-1).alias("d")))))
    steps = ends.unionByName(marks).groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    out = steps.select(*keys, F.col("at").cast("int").alias("start"), F.lead("at").over(w).cast("int").alias("stop"), F.sum("d").over(w).alias("covering"))
    return out.filter(F.col("stop").isNotNull())


def concat_offsets(segments: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """Where each segment starts when a document's segments are joined by line feeds."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("at", F.coalesce(F.sum(u16len(text) + 1).over(w), F.lit(0)).cast("long"))


def usable(spans: DataFrame, length: str = "n") -> DataFrame:
    return spans.filter(valid_span("start", "stop", length))


def box_conflicts(removed: DataFrame, kept: DataFrame, keys: list[str], name: str, scale: float, cell: float = 32.0) -> DataFrame:
    """Kept glyph boxes (keys, name, x0, y0, x1, y1) that a removed one covers by more than a pixel in both directions.

    Boxes are dealt to the cells of a grid that they touch; a pair meets in the cell of its common part's first corner,
    so a page of any number of glyphs is no nested loop. cell is about the size of a few glyphs.
    """
    home = lambda c: F.floor(c / F.lit(cell)).cast("long")
    span = lambda a, b: F.explode(F.sequence(home(F.col(a)), home(F.greatest(F.col(a), F.col(b)))))
    dealt = lambda df: df.withColumn("_across", span("x0", "x1")).withColumn("_down", span("y0", "y1"))
    r, k = dealt(removed).alias("r"), dealt(kept).alias("k")
    left, top = F.greatest("r.x0", "k.x0"), F.greatest("r.y0", "k.y0")
    covered = (F.least("r.x1", "k.x1") - left > 1 / scale) & (F.least("r.y1", "k.y1") - top > 1 / scale)
    on = [F.col(f"r.{c}") == F.col(f"k.{c}") for c in [*keys, "_across", "_down"]] + [covered, home(left) == F.col("k._across"), home(top) == F.col("k._down")]
    return k.join(r, on, "left_semi").select(*keys, name).distinct()


def restored(decisions: DataFrame, segments: DataFrame, doc: str, order: str) -> DataFrame:
    """Decisions on a joined document back at their segments: segment_id, start and stop of their own.

    segments: doc, order, segment_id, text; decisions: doc, start, stop, .... Starts of segments and of decisions are merged in
    one sort, so a document of many segments is no join by ranges. What lies in no single segment (it holds a line
    feed that joined two, or lies outside) has a null segment_id. Repeated decisions stay apart.
    """
    rest = [c for c in decisions.columns if c not in (doc, "start", "stop")]
    placed = concat_offsets(segments, doc, order).select(doc, F.col("at"), F.lit(0).alias("_kind"), F.struct("segment_id", "at", u16len("text").alias("n")).alias("_home"))
    asked = decisions.select(doc, F.col("start").cast("long").alias("at"), F.lit(1).alias("_kind"), F.struct("start", "stop", *rest).alias("_row"))
    w = Window.partitionBy(doc).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = placed.unionByName(asked, allowMissingColumns=True).withColumn("_in", F.last("_home", ignorenulls=True).over(w)).filter("_kind = 1")
    fits = F.coalesce((F.col("_row.stop") > F.col("_row.start")) & (F.col("_row.stop") <= F.col("_in.at") + F.col("_in.n")), F.lit(False))
    local = lambda c: F.when(fits, (F.col(f"_row.{c}") - F.col("_in.at")).cast("int")).alias(c)
    return both.select(doc, F.when(fits, F.col("_in.segment_id")).alias("segment_id"), local("start"), local("stop"), *[F.col(f"_row.{c}") for c in rest])
