"""Scalar functions over UTF-16 coordinates, all of them column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for the row, wherever and how often body uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf16(text: Column | str) -> Column:
    return F.encode(_c(text), "UTF-16BE")


def u16len(text: Column | str) -> Column:
    """Length in UTF-16 code units: the code points, or half the bytes of the encoded text where it has pairs."""
    text = _c(text)
    return F.when(has_pairs(text), F.octet_length(utf16(text)) / 2).otherwise(F.length(text)).cast("int")


def has_pairs(text: Column | str) -> Column:
    """Whether a text has characters of two UTF-16 units; in all others units and code points are the same."""
    text = _c(text)
    return (F.octet_length(text) > F.length(text)) & text.rlike("[\\x{10000}-\\x{10FFFF}]")


def units_before(text: Column | str, offsets: Column) -> Column:
    """map<int,int> from each of an array's code-point offsets to the units before it; the text is measured once, piece by piece."""
    text = _c(text)
    before = lambda order, k: F.when(k == 0, 0).otherwise(F.element_at(order, F.greatest(k, F.lit(1))))
    sizes = lambda order: F.transform(order, lambda x, k: bind(F.substring(text, before(order, k) + 1, x - before(order, k)), u16len))
    sums = lambda own: F.transform(own, lambda _, k: F.aggregate(F.slice(own, F.lit(1), k + 1), F.lit(0), lambda s, x: s + x))
    return bind(F.sort_array(F.array_distinct(offsets)), lambda order: F.map_from_arrays(order, bind(sizes(order), sums)))


def units_of(text: Column | str) -> Column:
    """What unit_slice() and unit_splits() need of a text, to be bound once for all its slices."""
    text = _c(text)
    return F.struct(text.alias("text"), has_pairs(text).alias("pairs"), F.when(has_pairs(text), utf16(text)).alias("raw"))


def u16slice(text: Column | str, start: Column | str, stop: Column | str) -> Column:
    """The text from start to stop, in units; half a pair at an end becomes the replacement character."""
    return bind(units_of(text), lambda units: unit_slice(units, _c(start), _c(stop)))


def unit_slice(units: Column, start: Column, stop: Column) -> Column:
    raw = F.substring(units["raw"], 2 * start + 1, 2 * (stop - start))
    size = F.octet_length(raw)
    unit = lambda at: F.hex(F.substring(raw, at, F.lit(2)))
    low, high = unit(F.lit(1)).between("DC00", "DFFF"), (size > 0) & unit(size - 1).between("D800", "DBFF")
    mark = lambda half: F.when(half, "\ufffd").otherwise("")
    whole = F.decode(F.substring(raw, F.when(low, 3).otherwise(1), size - F.when(low, 2).otherwise(0) - F.when(high, 2).otherwise(0)), "UTF-16BE")
    return F.when(units["pairs"], F.concat(mark(low), whole, mark(high))).otherwise(F.substring(units["text"], start + 1, stop - start))


def splits_pair(text: Column | str, offset: Column | str) -> Column:
    """Whether offset falls between the two halves of a surrogate pair."""
    return bind(units_of(text), lambda units: unit_splits(units, _c(offset)))


def unit_splits(units: Column, offset: Column) -> Column:
    unit = F.hex(F.substring(units["raw"], 2 * offset + 1, F.lit(2)))
    return units["pairs"] & (offset > 0) & unit.between("DC00", "DFFF")


def safe_boundary(text: Column | str, offset: Column | str, is_stop: bool) -> Column:
    """offset moved off a split pair: a start back, a stop on."""
    return F.when(splits_pair(text, offset), _c(offset) + (1 if is_stop else -1)).otherwise(_c(offset))


def valid_span(start: Column | str, stop: Column | str, length: Column | str) -> Column:
    return (_c(start) >= 0) & (_c(stop) > _c(start)) & (_c(stop) <= _c(length))


def alias_label(kind: Column | str, number: Column | str) -> Column:
    return F.concat(F.lit("["), _c(kind), F.lit("_"), _c(number).cast("string"), F.lit("]"))


def bullets(n: Column) -> Column:
    return F.repeat(F.lit(S.BULLET), n)


def preview(value: Column | str, kind: Column | str) -> Column:
    """A value as the review shows it, by its type; lengths and cuts are in UTF-16 units."""
    value, kind = _c(value), _c(kind)
    n, at = u16len(value), F.when(F.instr(value, "@") > 0, u16len(F.substring_index(value, "@", 1))).otherwise(-1)
    cut = lambda start, stop: u16slice(value, start, stop)
    email = F.concat(cut(F.lit(0), F.least(F.lit(2), at)), bullets(F.greatest(F.lit(3), at - 2)), cut(at, n))
    digits = F.regexp_replace(value, "[0-9](?=(?:[^0-9]*[0-9]){4})", S.BULLET)
    secret = F.concat(cut(F.lit(0), F.least(F.lit(3), n)), bullets(F.least(F.lit(12), F.greatest(F.lit(4), n - 3))))
    other = F.when(n > 4, F.concat(cut(F.lit(0), F.lit(2)), bullets(F.least(F.lit(8), n - 4)), cut(n - 2, n))).otherwise(bullets(n))
    return F.when((kind == "EMAIL") & (at > 0), email).when(kind.isin("PHONE", "CARD_NUMBER"), digits).when(kind == "SECRET", secret).otherwise(other)


def extension(name: Column | str) -> Column:
    """What follows the last dot, lower-cased; the whole name where there is none."""
    return F.lower(F.element_at(F.split(_c(name), "\\."), -1))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def document_kind(name: Column | str, mime: Column | str) -> Column:
    """The MIME type decides where it can, else the extension."""
    mime = F.lower(F.coalesce(_c(mime), F.lit("")))
    return (
        F.when(mime == "application/pdf", "pdf")
        .when((mime == "application/msword") | mime.contains("officedocument.wordprocessingml"), "docx")
        .when(mime.contains("hwp") | mime.contains("haansoft"), "hwpx")
        .when(mime.startswith("image/"), "image")
        .when(mime.startswith("text/"), "text")
        .otherwise(F.coalesce(F.try_element_at(_lookup(S.KIND_BY_EXTENSION), extension(name)), F.lit("unknown")))
    )


def text_mime(name: Column | str) -> Column:
    return F.try_element_at(_lookup(S.TEXT_MIME), extension(name))


def type_label(kind: Column | str) -> Column:
    return F.try_element_at(_lookup(S.LABELS), _c(kind))


def part_mime(path: Column | str) -> Column:
    """The content type of a word-processing part by its path."""
    path, base = _c(path), "application/vnd.openxmlformats-officedocument.wordprocessingml."
    out = F.when(path == "word/document.xml", base + "document.main+xml")
    for name in ("header", "footer"):
        out = out.when(path.startswith(f"word/{name}"), f"{base}{name}+xml")
    for name in ("footnotes", "endnotes", "styles", "numbering"):
        out = out.when(path == f"word/{name}.xml", f"{base}{name}+xml")
    return out.when(path.startswith("word/theme/"), "application/vnd.openxmlformats-officedocument.theme+xml")


def origin(url: Column | str) -> Column:
    """scheme://host[:port] in lower case, without a scheme's own port."""
    full = F.lower(F.regexp_extract(_c(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(full, r"^(http://[^:]*):80$", "$1"), r"^(https://[^:]*):443$", "$1")


def matches_any(url: Column | str, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | _c(url).rlike(p)
    return out


def error_code(message: Column | str) -> Column:
    """The first rule that a message fits."""
    out = None
    for code, pattern in S.ERROR_RULES:
        fits = _c(message).rlike(f"(?i){pattern}")
        out = F.when(fits, code) if out is None else out.when(fits, code)
    return out.otherwise(S.ERROR_DEFAULT)


def detector_error(message: Column | str, code: Column | str) -> Column:
    return F.when(_c(message).rlike(f"(?i){S.OUT_OF_MEMORY}"), "OUT_OF_MEMORY").otherwise(_c(code))


def notice_key(code: Column | str) -> Column:
    """Which notice a code shows: all model failures share one."""
    code = _c(code)
    return F.when(code.startswith("MODEL_") | code.isin("INFERENCE_FAILED", "OUT_OF_MEMORY"), "MODEL").otherwise(code)


def notice(code: Column | str) -> Column:
    """What the user is told about a code; unknown ones are told as a failure."""
    return F.coalesce(F.try_element_at(_lookup(S.NOTICES), notice_key(code)), F.lit(S.NOTICES[S.ERROR_DEFAULT]))


def location(segment_id: Column | str) -> Column:
    """Where a paragraph stands, for people; other ids as they are."""
    part = r"^docx:word/(document|header[0-9]+|footer[0-9]+|footnotes|endnotes)\.xml:p([0-9]+)$"
    segment_id = _c(segment_id)
    name = F.regexp_extract(segment_id, part, 1)
    number = F.regexp_extract(name, "([0-9]+)$", 1)
    section = F.when(name == "document", "본문").when(name.startswith("header"), F.concat(F.lit("머리글 "), number)).when(name.startswith("footer"), F.concat(F.lit("바닥글 "), number)).when(name == "footnotes", "각주").otherwise("미주")
    paragraph = (F.regexp_extract(segment_id, part, 2).try_cast("long") + 1).cast("string")
    return F.when(segment_id.rlike(part), F.concat(section, F.lit(" · "), paragraph, F.lit("번째 문단"))).otherwise(segment_id)


def relationship_source(path: Column | str) -> Column:
    """The part that a relationships file belongs to; '' is the package; null where path is none."""
    pattern = r"^((?:[^/]+/)*)_rels/([^/]*)\.rels$"
    return F.when(_c(path).rlike(pattern), F.concat(F.regexp_extract(_c(path), pattern, 1), F.regexp_extract(_c(path), pattern, 2)))


def same_text_key(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\s", "")


def client_id() -> Column:
    """A random name of 32 hexadecimal digits for each row."""
    return F.replace(F.uuid(), F.lit("-"))


def artifact_fits(content: Column | str, size: Column | str, sha256: Column | str) -> Column:
    return (F.octet_length(_c(content)) == _c(size)) & (F.sha2(_c(content).cast("binary"), 256) == _c(sha256))


def transport_chunks(content: Column | str, size: int = S.TRANSPORT_BYTES) -> Column:
    """Bytes as base64 pieces of size bytes."""
    content = _c(content).cast("binary")
    n = F.octet_length(content)
    return F.when(n == 0, F.expr("cast(array() AS array<string>)")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size)), lambda at: F.translate(F.base64(F.substring(content, at, F.lit(size))), "\r\n", "")))


def argmax(values: Column | str) -> Column:
    """Place of the greatest value from 0; the first of equal ones."""
    return F.array_position(_c(values), F.array_max(_c(values))).cast("int") - 1


def softmax_max(values: Column | str) -> Column:
    """The softmax share of the greatest value."""
    values = _c(values)
    return 1 / F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - F.array_max(values).cast("double")))


def softmax_of(values: Column | str, n: int) -> Column:
    """softmax_max() of n values, without a loop for each row; of any other number as there."""
    top = F.array_max(_c(values)).cast("double")
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.exp(F.get(_c(values), F.lit(i)).cast("double") - top)
    return F.when(F.size(_c(values)) == n, 1 / total).otherwise(softmax_max(values))
