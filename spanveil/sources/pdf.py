"""PDF text layers behind an interface: no PDF library is part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import same_text_key
from .office import code_of

GLYPHS = "doc_id string, segment_id string, text string, glyphs array<struct<char:string,start:int,stop:int,x0:double,y0:double,x1:double,y1:double>>"
NO_SPANS = "cast(array() AS array<struct<start:int,stop:int>>)"


def looks_like_pdf(content: str = "content") -> Column:
    """The mark within the first 1024 bytes, and a size within the limit."""
    head = F.decode(F.substring(F.col(content), F.lit(1), F.lit(1024)), "ISO-8859-1")
    return head.contains("%PDF-") & (F.octet_length(content) <= S.PDF_LIMITS["input_bytes"])


def segments(files: DataFrame, open_pdf: Callable[[bytes, dict], list[tuple[str, str, list[dict]]]], limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects): pages as segments, by a reader: bytes and limits to (page id, text, glyphs) of each page.

    What the reader raises, and files with too many pages or characters or without text, are rejects of their own.
    """
    limits = S.PDF_LIMITS | (limits or {})

    def pages_of(content: bytes) -> list[tuple]:
        pages = open_pdf(content, limits)
        if not 0 < len(pages) <= limits["pages"]:
            raise ValueError("unsupported PDF page count")
        if sum(len(text.encode("utf-16-le")) // 2 for _, text, _ in pages) > limits["characters"]:
            raise ValueError("text limit exceeded")
        if any(not text.strip() for _, text, _ in pages):
            raise ValueError("requires OCR")
        return pages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    rows += [(doc, *page, None) for page in pages_of(bytes(content))]
                except Exception as e:  # a file's failure costs its own row
                    rows.append((doc, None, None, None, code_of(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "segment_id", "text", "glyphs", "code"])

    good = F.coalesce(looks_like_pdf(), F.lit(False))
    read = files.filter(good).select("doc_id", "content").mapInPandas(run, GLYPHS + ", code string")
    large = F.octet_length("content") > S.PDF_LIMITS["input_bytes"]
    refused = files.filter(~good).select("doc_id", F.when(F.col("content").isNull(), S.ERROR_DEFAULT).when(large, "DOCUMENT_LIMIT").otherwise("DOCUMENT_FORMAT").alias("code"))
    rejects = read.filter(F.col("code").isNotNull()).select("doc_id", "code").unionByName(refused).select("doc_id", F.lit("extracting").alias("stage"), "code")
    return read.filter(F.col("code").isNull()).drop("code"), rejects


def output_differs(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Documents (keys) whose output fails: another number of pages, or a page (page, text) of another text but for white space."""
    want = expected.select(*keys, "page", F.md5(same_text_key("text")).alias("_want"), F.lit(1).alias("_e"))
    have = found.select(*keys, "page", F.md5(same_text_key("text")).alias("_have"), F.lit(1).alias("_f"))
    both = want.join(have, [*keys, "page"], "full")
    same = F.col("_e").isNotNull() & F.col("_f").isNotNull() & F.col("_want").eqNullSafe(F.col("_have"))
    return both.filter(~same).select(*keys).distinct()


def kept_text(pages: DataFrame, masks: DataFrame, scale: float = S.PDF_LIMITS["scale"]) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects): pages with the text of the glyphs that no span touches.

    A span that touches no glyph, and a visible glyph that a removed one covers by more than a pixel in both directions,
    refuse the file.
    """
    joined = pages.join(masks.select("doc_id", "segment_id", "spans"), ["doc_id", "segment_id"], "left").withColumn("spans", F.coalesce("spans", F.expr(NO_SPANS)))
    meets = lambda g, s: (s["start"] < g["stop"]) & (g["start"] < s["stop"])
    removed = F.filter("glyphs", lambda g: F.exists("spans", lambda s: meets(g, s)))
    kept = F.filter("glyphs", lambda g: ~F.exists("spans", lambda s: meets(g, s)))
    unmapped = F.exists("spans", lambda s: ~F.exists("glyphs", lambda g: meets(g, s)))
    across = lambda a, b, x: F.least(a[f"{x}1"], b[f"{x}1"]) - F.greatest(a[f"{x}0"], b[f"{x}0"]) > 1 / scale
    ambiguous = F.exists(removed, lambda r: F.exists(kept, lambda k: (F.trim(k["char"]) != "") & across(r, k, "x") & across(r, k, "y")))
    checked = joined.withColumn("bad", unmapped | ambiguous).withColumn("kept", F.array_join(F.transform(kept, lambda g: g["char"]), ""))
    bad = checked.groupBy("doc_id").agg(F.bool_or("bad").alias("bad")).filter("bad").select("doc_id")
    return checked.drop("bad").join(bad, "doc_id", "left_anti"), bad.select("doc_id", F.lit("rebuilding").alias("stage"), F.lit(S.ERROR_DEFAULT).alias("code"))
