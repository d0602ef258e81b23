"""ZIP packages with XML parts: inspection, guarded parsing, writing. Pure Python, run inside Arrow batches."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from dataclasses import dataclass
from xml.dom import minidom
from xml.parsers.expat import ExpatError

from .. import schemas as S

# Signatures and lengths of the ZIP format.
LOCAL, CENTRAL, END_OF_DIRECTORY = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
CENTRAL_HEAD, LOCAL_HEAD, END_HEAD = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H"), struct.Struct("<4s4H2LH")
FORBIDDEN_XML = re.compile(rb"<!\s*(?:DOCTYPE|ENTITY)", re.I)


class Refused(Exception):
    """A package that is not processed; the message never holds document text."""


@dataclass
class Entry:
    name: str
    size: int
    compressed: int
    crc: int
    method: int
    offset: int
    flags: int


def directory(data: bytes, limits: dict) -> list[Entry]:
    """The central directory's entries, checked against the local headers: no gaps, overlaps, tricks or twins."""
    if len(data) > limits["input_bytes"]:
        raise Refused("input size limit exceeded")
    at = data.rfind(END_OF_DIRECTORY)
    if at < 0 or at + END_HEAD.size > len(data):
        raise Refused("not a ZIP package")
    _, disk, first_disk, here, total, size, start, comment = END_HEAD.unpack_from(data, at)
    if disk or first_disk or here != total or at + END_HEAD.size + comment != len(data) or start + size != at or 0xFFFF in (here, total) or 0xFFFFFFFF in (size, start):
        raise Refused("split, extended or damaged ZIP directory")
    if total > limits["entries"]:
        raise Refused("ZIP entry limit exceeded")
    out, names = [], set()
    for _ in range(total):
        if start + CENTRAL_HEAD.size > at:
            raise Refused("damaged ZIP directory")
        sig, _, _, flags, method, _, _, crc, packed, plain, n, extra, note, _, _, _, offset = CENTRAL_HEAD.unpack_from(data, start)
        raw = data[start + CENTRAL_HEAD.size : start + CENTRAL_HEAD.size + n]
        if sig != CENTRAL or flags & 0x2041 or method not in (0, 8):
            raise Refused("encrypted or unsupported ZIP entry")
        if not raw.isascii() or b"\\" in raw or b":" in raw or raw.startswith(b"/") or any(p in (b"", b".", b"..") for p in raw.rstrip(b"/").split(b"/")):
            raise Refused("unsafe ZIP path")
        name = raw.decode()
        if name.lower() in names:
            raise Refused("duplicate ZIP path")
        names.add(name.lower())
        out.append(Entry(name, plain, packed, crc, method, offset, flags))
        start += CENTRAL_HEAD.size + n + extra + note
    if sum(e.size for e in out) > limits["expanded_bytes"]:
        raise Refused("expanded ZIP size limit exceeded")
    _check_local(data, out)
    return out


def _check_local(data: bytes, entries: list[Entry]) -> None:
    stop = 0
    for e in sorted(entries, key=lambda e: e.offset):
        if e.offset != stop or e.offset + LOCAL_HEAD.size > len(data):
            raise Refused("ZIP entries overlap or leave gaps")
        sig, _, flags, method, _, _, crc, packed, plain, n, extra = LOCAL_HEAD.unpack_from(data, e.offset)
        body = e.offset + LOCAL_HEAD.size + n + extra
        if sig != LOCAL or flags != e.flags or method != e.method or data[e.offset + LOCAL_HEAD.size :][:n] != e.name.encode():
            raise Refused("ZIP headers disagree")
        if not flags & 8 and (crc, packed, plain) != (e.crc, e.compressed, e.size):
            raise Refused("ZIP headers disagree")
        stop = body + e.compressed
        if flags & 8:  # a data descriptor follows, with or without its signature
            stop += 16 if data[stop : stop + 4] == b"PK\x07\x08" else 12


def parts(data: bytes, limits: dict) -> dict[str, bytes]:
    """All entries' contents, each with its size and CRC-32 confirmed."""
    out = {}
    for e in directory(data, limits):
        body = e.offset + LOCAL_HEAD.size + sum(struct.unpack_from("<2H", data, e.offset + 26))
        raw = data[body : body + e.compressed]
        try:
            plain = raw if e.method == 0 else zlib.decompressobj(-15).decompress(raw, e.size + 1)
        except zlib.error:
            raise Refused("damaged ZIP entry") from None
        if len(plain) != e.size or zlib.crc32(plain) != e.crc:
            raise Refused("ZIP checksum does not fit")
        if not e.name.endswith("/"):
            out[e.name] = plain
    return out


def parse(data: bytes, limits: dict) -> minidom.Document:
    """XML without a DTD or entities, in UTF-8, of bounded depth; comments and instructions fall away."""
    if FORBIDDEN_XML.search(data):
        raise Refused("unsupported XML declaration")
    try:
        text = data.decode("utf-8-sig")
        declared = re.match(r"<\?xml[^>]*encoding\s*=\s*[\"']([^\"']+)", text)
        if declared and declared[1].lower().replace("-", "") != "utf8":
            raise Refused("unsupported XML encoding")
        document = minidom.parseString(text.encode())
    except (UnicodeDecodeError, ExpatError):
        raise Refused("invalid XML") from None
    pending = [(document, 0)]
    while pending:
        node, depth = pending.pop()
        if depth > limits["depth"]:
            raise Refused("XML nesting limit exceeded")
        for child in list(node.childNodes):
            if child.nodeType in (child.COMMENT_NODE, child.PROCESSING_INSTRUCTION_NODE):
                node.removeChild(child)
            else:
                pending.append((child, depth + 1))
    return document


def descendants(node, local: str, namespace: str) -> list:
    """Elements of that name below node, in document order."""
    return list(node.getElementsByTagNameNS(namespace, local))


def write(contents: dict[str, bytes], stored: tuple[str, ...] = (), limits: dict | None = None) -> bytes:
    """A package in the given order; entries named in stored come first, uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in [*stored, *[n for n in contents if n not in stored]]:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, contents[name], zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED, 6)
    data = out.getvalue()
    if len(data) > (limits or S.PACKAGE_LIMITS)["output_bytes"]:
        raise Refused("output size limit exceeded")
    return data


def utf16_cut(text: str, start: int, stop: int) -> str:
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * stop].decode("utf-16-le", "surrogatepass")


def utf16_len(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def blocked(text: str, spans: list[tuple[int, int]]) -> str:
    """text with its spans as blocks, one a UTF-16 unit; spans must lie inside and split no pair."""
    raw = bytearray(text.encode("utf-16-le"))
    for start, stop in spans:
        if not 0 <= start < stop <= len(raw) // 2:
            raise Refused("invalid mask span")
        raw[2 * start : 2 * stop] = S.BLOCK.encode("utf-16-le") * (stop - start)
    try:
        return raw.decode("utf-16-le")
    except UnicodeDecodeError:
        raise Refused("a mask splits a character") from None
