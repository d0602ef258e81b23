"""Word-processing packages (DOCX and HWPX) as segments, and their masked copies.

Paragraphs are the segments. A paragraph's text stands in pieces, the text nodes; a mask may run over several.
Everything runs per file inside mapInPandas; a file that is refused gives a reject row and no segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from .package import Refused, blocked, descendants, parse, parts, utf16_cut, utf16_len, write
from .word_parts import HYPHENS, WORD, check_text_part, closed

# Namespace and media type of the second format.
HANGUL = "http://www.hancom.co.kr/hwpml/2011/paragraph"
HANGUL_MIME = b"application/hwp+zip"
SEGMENT_SCHEMA = "doc_id string, ord int, segment_id string, text string, code string"
FILE_SCHEMA = "doc_id string, content binary, code string"


@dataclass
class Paragraph:
    segment_id: str
    text: str
    pieces: list = field(default_factory=list)  # (node, start, stop, text)


def _word_paragraphs(path: str, document, styles: dict[str, str]) -> list[Paragraph]:
    check_text_part(document, styles)
    out, mapped = [], 0
    for n, p in enumerate(descendants(document, "p", WORD)):
        if descendants(p, "p", WORD):
            raise Refused("DOCX: nested paragraph")
        one = Paragraph(f"docx:{path}:p{n}", "")
        for e in p.getElementsByTagNameNS(WORD, "*"):
            in_run = e.parentNode.localName == "r"
            value = ({"tab": "\t", "br": "\n", "cr": "\n"} | HYPHENS).get(e.localName) if in_run else None
            if e.localName == "t":
                value = "".join(c.data for c in e.childNodes)
                mapped += 1
            if value:
                start = utf16_len(one.text)
                one.text += value
                one.pieces.append((e, start, start + utf16_len(value), value))
        out.append(one)
    if mapped != len(descendants(document, "t", WORD)):
        raise Refused("DOCX: text outside paragraphs")
    return out


def _hangul_paragraphs(path: str, document, styles: dict[str, str]) -> list[Paragraph]:
    out = []
    for p in descendants(document, "p", HANGUL):
        one = Paragraph(f"hwpx:{path}:p{len(out)}", "")
        for e in descendants(p, "t", HANGUL):
            value = "".join(_text_below(e))
            if value:
                start = utf16_len(one.text)
                one.text += value
                one.pieces.append((e, start, start + utf16_len(value), value))
        if one.text:
            out.append(one)
    return out


def _text_below(node) -> Iterator[str]:
    for c in node.childNodes:
        if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE):
            yield c.data
        else:
            yield from _text_below(c)


def without_previews(contents: dict[str, bytes], limits: dict) -> dict[str, bytes]:
    """The package without its previews, which repeat its text, and without what names them as roots."""
    out, roots = {n: x for n, x in contents.items() if not n.startswith("Preview/")}, "META-INF/container.xml"
    if roots in out and len(out) < len(contents):
        document = parse(out[roots], limits)
        for e in [x for x in document.getElementsByTagName("*") if x.getAttribute("full-path").startswith("Preview/")]:
            e.parentNode.removeChild(e)
        out[roots] = document.toxml(encoding="UTF-8")
    return out


class Package:
    """An opened file: its parts, and the paragraphs of those that hold text."""

    def __init__(self, kind: str, data: bytes, limits: dict):
        self.kind, self.limits, self.contents = kind, limits, parts(data, limits)
        if kind == "docx":
            styles: dict[str, str] = {}
            self.contents, names = closed(self.contents, limits, styles)
            read = _word_paragraphs
        else:
            if self.contents.get("mimetype", b"").strip() != HANGUL_MIME:
                raise Refused("not an HWPX package")
            found = {n: int(m[1]) for n in self.contents if (m := re.fullmatch(r"Contents/section(\d+)\.xml", n, re.I))}
            names = sorted(found, key=found.get)
            if not names:
                raise Refused("HWPX: no supported section XML")
            read, styles = _hangul_paragraphs, {}
            self.contents = without_previews(self.contents, limits)
        self.read, self.documents = read, {n: parse(self.contents[n], limits) for n in names}
        self.paragraphs = {n: read(n, d, styles) for n, d in self.documents.items()}
        self.segments = [p for n in names for p in self.paragraphs[n]]
        if not any(p.text for p in self.segments):
            raise Refused("no supported paragraph text")
        if len(self.segments) > limits["paragraphs"] or sum(utf16_len(p.text) for p in self.segments) > limits["characters"]:
            raise Refused("document text limit exceeded")

    def masked(self, masks: dict[str, list[tuple[int, int]]]) -> bytes:
        """The package with its spans as blocks; every segment needs an entry. The result is opened again and compared."""
        if set(masks) != {p.segment_id for p in self.segments}:
            raise Refused("masks do not fit the segments")
        wanted = {p.segment_id: blocked(p.text, masks[p.segment_id]) for p in self.segments}
        for p in self.segments:
            for node, start, stop, old in p.pieces:
                new = utf16_cut(wanted[p.segment_id], start, stop)
                if new != old:
                    self._put(node, new)
        contents = {**self.contents, **{n: d.toxml(encoding="UTF-8") for n, d in self.documents.items()}}
        data = write(contents, ("mimetype",) if self.kind == "hwpx" else (), self.limits)
        again = Package(self.kind, data, {**self.limits, "input_bytes": self.limits["output_bytes"]})
        if {p.segment_id: p.text for p in again.segments} != wanted:
            raise Refused("output verification failed")
        return data

    @staticmethod
    def _put(node, text: str) -> None:
        if node.localName != "t":  # a masked tab or break becomes text of its run
            new = node.ownerDocument.createElementNS(node.namespaceURI, f"{node.prefix}:t" if node.prefix else "t")
            node.parentNode.replaceChild(new, node)
            node = new
        while node.firstChild:
            node.removeChild(node.firstChild)
        node.appendChild(node.ownerDocument.createTextNode(text))


def code_of(error: Exception) -> str:
    message = str(error)
    return next((c for c, p in S.ERROR_RULES if re.search(p, message, re.I)), S.ERROR_DEFAULT)


def segments(files: DataFrame, kind: str, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, content) to segments (doc_id, ord, segment_id, text) and rejects."""
    limits = S.PACKAGE_LIMITS | (limits or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    rows = [(doc, i, p.segment_id, p.text, None) for i, p in enumerate(Package(kind, bytes(content), limits).segments)]
                except Exception as e:  # whatever a file does, it costs its own reject row and no other file
                    rows = [(doc, None, None, None, code_of(e))]
                yield pd.DataFrame(rows, columns=["doc_id", "ord", "segment_id", "text", "code"]).astype({"ord": "Int32"})

    fits = F.coalesce(F.octet_length("content") <= limits["input_bytes"], F.lit(False))
    rows = files.filter(fits).select("doc_id", "content").mapInPandas(run, SEGMENT_SCHEMA)
    rejects = rows.filter(F.col("code").isNotNull()).select("doc_id", F.lit("extracting").alias("stage"), "code")
    large = files.filter(~fits).select("doc_id", F.lit("extracting").alias("stage"), F.when(F.col("content").isNull(), S.ERROR_DEFAULT).otherwise("DOCUMENT_LIMIT").alias("code"))
    return rows.filter(F.col("code").isNull()).drop("code"), rejects.unionByName(large)


def rebuild(files: DataFrame, masks: DataFrame, kind: str, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, content) and masks(doc_id, segment_id, spans), a row for every segment, to masked files and rejects."""
    limits = S.PACKAGE_LIMITS | (limits or {})
    each = masks.groupBy("doc_id").agg(F.collect_list(F.struct("segment_id", "spans")).alias("masks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content, own in zip(pdf["doc_id"], pdf["content"], pdf["masks"], strict=True):
                try:
                    spans = {m["segment_id"]: [(s["start"], s["stop"]) for s in m["spans"]] for m in own}
                    if len(spans) != len(own):
                        raise Refused("masks do not fit the segments")
                    rows.append((doc, Package(kind, bytes(content), limits).masked(spans), None))
                except Exception as e:  # as above
                    rows.append((doc, None, code_of(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "code"])

    rows = files.join(each, "doc_id").select("doc_id", "content", "masks").mapInPandas(run, FILE_SCHEMA)
    return rows.filter(F.col("code").isNull()).drop("code"), rows.filter(F.col("code").isNotNull()).select("doc_id", F.lit("rebuilding").alias("stage"), "code")
