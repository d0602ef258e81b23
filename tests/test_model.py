"""Tokenizer offsets, the model path with a fake classifier, and the remaining scalar functions."""

import hashlib
import re
import sys
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanveil.functions import text as X
from spanveil.functions.wordpiece import WordPiece, composed
from spanveil.operators import model, spans, tokens
from spanveil.plans import mask_documents
from spanveil.sources import artifact, pdf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't import tests

NAMES = ["[UNK]", "[CLS]", "[SEP]", "김", "##민", "##수", "call", "##ing", "me", ".", "é", "[X]", "a", "##b"]
PIECES = WordPiece({n: i for i, n in enumerate(NAMES)}, added=["[X]"])


def test_offsets():
    assert PIECES.encode("😀 김민수 calling") == [(0, 0, 2), (3, 3, 4), (4, 4, 5), (5, 5, 6), (6, 7, 11), (7, 11, 14)]
    assert PIECES.encode("me[X]me.") == [(8, 0, 2), (11, 2, 5), (8, 5, 7), (9, 7, 8)]
    assert PIECES.encode("é x") == [(10, 0, 2), (0, 3, 4)]
    assert PIECES.encode("") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aẹ́김가😀 .", max_size=20))
def test_composition_keeps_its_sources(text):
    normal, ranges = composed(text)
    assert normal == "".join(unicodedata.normalize("NFC", c) for c in __import__("regex").findall(r"\X", text))
    assert len(ranges) == len(normal) and {i for a, b in ranges for i in range(a, b)} == set(range(len(text)))


LABELS = ["O", "B-PERSON", "I-PERSON"]


def fake(ids):
    """A person starts at 김, and ##민 and ##수 go on."""
    out = np.zeros((len(ids), 3), np.float32)
    for k, i in enumerate(ids):
        out[k, {3: 1, 4: 2, 5: 2}.get(i, 0)] = 4
    return out


def test_model_detection(spark):
    rows = [(1, "me 김민수 me"), (2, ""), (3, "me"), (4, "me " * 509 + "김민수 " + "me " * 200)]
    got = model.detect(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], PIECES, fake, LABELS).collect()
    assert sorted((r.doc_id, r.type, r.start, r.stop) for r in got) == [(1, "PERSON", 3, 6), (4, "PERSON", 1527, 1530)]
    with pytest.raises(ValueError):
        model.check_labels(["O", "B-PERSON", "I-PHONE"])


def test_one_failure_costs_one_document(spark):
    def breaks(ids):
        if 6 in ids:
            raise MemoryError("out of memory")
        return fake(ids) if 9 not in ids else np.full((len(ids), 3), np.nan, np.float32)

    rows = [(1, "a", "me 김민수"), (1, "b", "me"), (2, "a", "김"), (2, "b", "calling"), (3, "a", "me."), (4, "a", "")]
    segments = spark.createDataFrame(rows, "doc_id long, segment_id string, text string")
    found, rejects = model.scan(segments, ["doc_id", "segment_id"], PIECES, breaks, LABELS, ["doc_id"])
    assert [(r.doc_id, r.segment_id, r.start, r.stop) for r in found.collect()] == [(1, "a", 3, 6)]
    assert sorted((r.doc_id, r.stage, r.code) for r in rejects.collect()) == [(2, "detecting", "OUT_OF_MEMORY"), (3, "detecting", "INFERENCE_FAILED")]
    with pytest.raises(Exception, match="OUT_OF_MEMORY"):
        model.detect(segments.filter("doc_id = 2"), ["doc_id", "segment_id"], PIECES, breaks, LABELS).collect()


def test_half_floats():
    assert model.widen_half(np.array([0x8000, 0x0001, 0x3C00, 0x7C00], "<u2").tobytes()).tolist() == [-0.0, 2.0**-24, 1.0, float("inf")]


def test_more_scalars(spark):
    df = spark.createDataFrame([("word/header2.xml", "word/_rels/document.xml.rels", "MODEL_X"), ("x", "_rels/.rels", "DOCUMENT_LIMIT")], "p string, r string, c string")
    rows = df.select(X.part_mime("p").alias("m"), X.relationship_source("r").alias("s"), X.relationship_source("p").alias("n"), X.notice_key("c").alias("k")).collect()
    assert [(r.m and r.m.split(".")[-1], r.s, r.n, r.k) for r in rows] == [("header+xml", "word/document.xml", None, "MODEL"), (None, "", None, "DOCUMENT_LIMIT")]
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    one = spark.createDataFrame([(bytearray(b"abc"), 3, sha)], "b binary, n int, h string")
    assert one.select(X.artifact_fits("b", "n", "h").alias("ok")).first().ok
    toks = spark.createDataFrame([(1, [(5, 0, 2, 1, 0)]), (2, [(5, 2, 1, 1, 0)])], "id int, t array<struct<id:int,start:int,stop:int,attn:int,special:int>>").withColumn("n", F.lit(4))
    assert [r.ok for r in toks.orderBy("id").select(tokens.tokens_are_sound("t", "n").alias("ok")).collect()] == [True, False]
    assert [x.id for x in toks.filter("id = 1").select(tokens.wrapped("t", 101, 102).alias("w")).first().w] == [101, 5, 102]


def test_boxes_and_glyphs(spark):
    box = "page string, name string, x0 double, y0 double, x1 double, y1 double"
    kept = spark.createDataFrame([("p", "a", 0.0, 0.0, 4.0, 4.0), ("p", "b", 9.0, 0.0, 12.0, 4.0)], box)
    gone = spark.createDataFrame([("p", "c", 3.0, 1.0, 9.4, 3.0)], box)
    assert [r.name for r in spans.box_conflicts(gone, kept, ["page"], "name", 2.0).collect()] == ["a"]
    glyphs = [("a", 0, 1, 0.0, 0.0, 1.0, 1.0), ("b", 1, 2, 1.0, 0.0, 2.0, 1.0), ("c", 2, 3, 2.0, 0.0, 3.0, 1.0)]
    pages = spark.createDataFrame([("d", "page-1", "abc", glyphs)], pdf.GLYPHS)
    masks = spark.createDataFrame([("d", "page-1", [(1, 2)])], "doc_id string, segment_id string, spans array<struct<start:int,stop:int>>")
    assert pdf.kept_text(pages, masks)[0].first().kept == "ac"
    files = spark.createDataFrame([("d", bytearray(b"%PDF-1.4 x")), ("e", bytearray(b"none"))], "doc_id string, content binary")
    named = [dict(zip(("char", "start", "stop", "x0", "y0", "x1", "y1"), g, strict=True)) for g in glyphs]
    out, rejects = pdf.segments(files, lambda data, limits: [("page-1", "abc", named)])
    assert [(r.doc_id, len(r.glyphs)) for r in out.collect()] == [("d", 3)]
    assert [tuple(r) for r in rejects.collect()] == [("e", "extracting", "DOCUMENT_FORMAT")]


def test_pdf_refusals(spark):
    """What a reader raises, pages beyond the limits or without text, spans without glyphs, and glyphs under others."""

    def reader(data, limits):
        kind = data[8:].decode()
        if kind == "locked":
            raise ValueError("Encrypted or unsupported document")
        glyphs = [dict(char=c, start=i, stop=i + 1, x0=float(i), y0=0.0, x1=i + (3.0 if kind == "over" else 1.0), y1=5.0) for i, c in enumerate("ab@x.example.com" if kind != "blank" else " ")]
        text = "".join(g["char"] for g in glyphs)
        return [("page-1", text, glyphs if kind != "bare" else [])] * (200 if kind == "long" else 1)

    files = [(k, None if k == "null" else bytearray(b"%PDF-1.4" + k.encode())) for k in ("fine", "locked", "blank", "bare", "long", "over", "null")]
    files = spark.createDataFrame(files, "doc_id string, content binary")
    everything = lambda segments, keys: segments.select(*keys, F.lit(0).alias("ord"), F.lit("EMAIL").alias("type"), F.lit(0.9).alias("confidence"), F.lit(0).alias("start"), F.lit(4).alias("stop"))
    done, rejects = mask_documents.mask_pdf(files, reader, detector=everything)
    assert [(r.doc_id, r.kept) for r in done.collect()] == [("fine", ".example.com")]
    assert {r.doc_id: (r.stage, r.code) for r in rejects.collect()} == {
        "locked": ("extracting", "DOCUMENT_FORMAT"), "blank": ("extracting", "PDF_OCR_REQUIRED"), "long": ("extracting", "DOCUMENT_LIMIT"), "null": ("extracting", "DOCUMENT_FAILED"),
        "bare": ("rebuilding", "DOCUMENT_FAILED"), "over": ("rebuilding", "DOCUMENT_FAILED"),
    }


def test_mask_text(spark):
    df = spark.createDataFrame([(1, "mail a@b.example.com or c@d.example.com or a@b.example.com"), (2, "nothing")], "doc_id long, text string")
    out = {r.doc_id: r.masked for r in mask_documents.mask_text(df, ["doc_id"]).collect()}
    assert out == {1: "mail [EMAIL_1] or [EMAIL_2] or [EMAIL_1]", 2: "nothing"}


def test_artifacts(spark, tmp_path):
    content = b"weights" * 1000
    sha = hashlib.sha256(content).hexdigest()
    cache, source = tmp_path / "cache", tmp_path / "source"
    cache.mkdir()
    source.mkdir()
    get = lambda: artifact.load_artifact(spark, "m.bin", len(content), sha, f"file://{cache}", f"file://{source}")
    with pytest.raises(ValueError, match="MODEL_DOWNLOAD_FAILED"):
        get()
    (source / "m.bin").write_bytes(content)
    assert get() == content and (cache / "m.bin").read_bytes() == content
    (source / "m.bin").write_bytes(b"gone")
    assert get() == content
    (cache / "m.bin").write_bytes(b"broken")
    with pytest.raises(ValueError, match="MODEL_DOWNLOAD_FAILED"):
        get()
    (source / "m.bin").write_bytes(content)
    assert get() == content and (cache / "m.bin").read_bytes() == content


def test_labels_and_names(spark):
    model.check_labels(LABELS, 3, {"O": 0, "B-PERSON": 1, "I-PERSON": 2})
    for size, ids in ((37, None), (3, {"O": 0, "B-PERSON": 2, "I-PERSON": 1})):
        with pytest.raises(ValueError):
            model.check_labels(LABELS, size, ids)
    names = [r.n for r in spark.range(50).select(X.client_id().alias("n")).collect()]
    assert len(set(names)) == 50 and all(re.fullmatch("[0-9a-f]{32}", n) for n in names)
    assert set(mask_documents.processors()) == {"docx", "hwpx", "text"} and "pdf" in mask_documents.processors(lambda data: None)
