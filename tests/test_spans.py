"""Golden cases and randomised properties of the span operators."""

import random
import re
import zipfile
from io import BytesIO

import greedy
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil import queries
from spanveil import schemas as S
from spanveil.functions import text as X
from spanveil.operators import detect, masking, policy, reconcile, review, spans, tokens
from spanveil.plans import mask_documents
from spanveil.sources import office, package, textfile

DET = "doc_id long, ord int, type string, confidence double, start int, stop int"


def dets(spark, rows):
    return spark.createDataFrame([(d, i, t, 0.9, a, b) for i, (d, t, a, b) in enumerate(rows)], DET)


def masked(spark, text, rows):
    texts = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return masking.mask_aliases(texts, dets(spark, [(1, *r) for r in rows]), ["doc_id"]).first().masked


@pytest.mark.parametrize(
    ("text", "rows", "want"),
    [
        ("abcdefghij", [("RRN", 0, 5), ("PHONE", 3, 10)], "[RRN_1]"),
        ("abcdefghij", [("RRN", 0, 5), ("PHONE", 5, 10)], "[RRN_1][PHONE_1]"),
        ("😀abcde😀Z", [("RRN", 0, 5), ("PHONE", 4, 9)], "[RRN_1]Z"),
        ("abcdefghij", [("RRN", 0, 5), ("RRN", -1, 3), ("RRN", 4, 4), ("RRN", 3, 40)], "[RRN_1]fghij"),
        ("김민수 이영희 김민수", [("PERSON", 0, 3), ("PERSON", 4, 7), ("PERSON", 8, 11)], "[PERSON_1] [PERSON_2] [PERSON_1]"),
        ("plain", [], "plain"),
    ],
)
def test_mask_aliases(spark, text, rows, want):
    assert masked(spark, text, rows) == want


def test_block_mask_keeps_width(spark):
    texts = spark.createDataFrame([(1, "0123456789"), (2, "a😀b")], "doc_id long, text string")
    rows = dets(spark, [(1, "RRN", 1, 3), (1, "RRN", 7, 9), (2, "RRN", 1, 3)])
    out = {r.doc_id: r.masked for r in masking.mask_blocks(texts, rows, ["doc_id"]).collect()}
    assert out == {1: "0██3456██9", 2: "a██b"}


def test_spans_that_split_a_pair_cost_no_job(spark):
    texts = spark.createDataFrame([(1, "a😀b"), (2, "plain text")], "doc_id long, text string")
    rows = dets(spark, [(1, "RRN", 0, 2), (2, "RRN", 0, 5)])
    out = {r.doc_id: r.masked for r in masking.mask_aliases(texts, rows, ["doc_id"]).collect()}
    assert out == {1: "[RRN_1]\ufffdb", 2: "[RRN_1] text"}


def test_union_rules(spark):
    rows = dets(spark, [(1, "RRN", 0, 5), (1, "PHONE", 5, 10), (1, "PERSON", 1, 2), (1, "DATE", 9, 12)])
    strict = spans.union_spans(rows, ["doc_id"], False).orderBy("start").collect()
    assert [(r.start, r.stop, r.type) for r in strict] == [(0, 5, "RRN"), (5, 12, "PHONE")]
    assert [(r.start, r.stop) for r in spans.union_spans(rows, ["doc_id"], True).collect()] == [(0, 12)]


def test_reconcile_in_runs_is_reconcile_as_a_whole(spark):
    """All runs at once give what one ranked pass over the segment gives, scores of tokens included."""
    rng = random.Random(3)
    rows = []
    for d in range(400):
        for i in range(rng.randrange(14)):
            a = rng.randrange(60)
            rows.append((d, i, rng.choice(["PERSON", "PHONE"]), rng.randrange(100) / 100, a, a + rng.randrange(1, 12), rng.randrange(3), rng.random() < 0.4, rng.random() < 0.4, [(k, rng.random()) for k in range(a, a + rng.randrange(4))] if d % 2 else None))
    names = ["doc_id", "ord", "type", "confidence", "start", "stop", "chunk", "truncated_start", "truncated_stop", "tokens"]
    table = spark.createDataFrame(rows, "doc_id long, ord int, type string, confidence double, start int, stop int, chunk int, truncated_start boolean, truncated_stop boolean, tokens array<struct<token_index:int,confidence:double>>")
    near = lambda r: (*r[:2], round(r[2], 9), *r[3:])
    got = sorted(near(tuple(r)) for r in reconcile.merge_chunks(table, ["doc_id"]).collect())
    want = []
    for d in range(400):
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == d]
        for v in own:
            v["tokens"] = None if v["tokens"] is None else [{"token_index": k, "confidence": c} for k, c in v["tokens"]]
        want += [(d, e.type, round(e.confidence, 9), e.start, e.stop, e.chunk, e.clipped) for e in greedy.merge_views(own)]
    assert [(*r[:1], *r[1:]) for r in got] == sorted((d, t, c, a, b, k, x) for d, t, c, a, b, k, x in want)


def test_overlaps_meet_in_buckets(spark):
    """Any width gives the same pairs; a document of many pieces is no nested loop."""
    rng = random.Random(4)
    mark = lambda n: [(d, i, a, a + rng.choice((0, 1, 3, 40))) for d in range(3) for i in range(n) for a in [rng.randrange(200)]]
    one, two = mark(60), mark(50)
    masks = spark.createDataFrame([(d, a, b) for d, _, a, b in one], "doc_id int, start int, stop int")
    pieces = spark.createDataFrame(two, "doc_id int, piece int, piece_start int, piece_stop int")
    want = sorted((d, i, max(a, x), min(b, y)) for d, _, a, b in one for e, i, x, y in two if d == e and a < y and x < b)
    for width in (1, 7, 4096):
        got = spans.overlap_join(masks, pieces, ["doc_id"], width).select("doc_id", "piece", "start", "stop").collect()
        assert sorted(map(tuple, got)) == want
    long = spark.range(300_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 4).cast("int").alias("piece_start"), (F.col("id") * 4 + 4).cast("int").alias("piece_stop"))
    cuts = spark.range(300_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 4 + 2).cast("int").alias("start"), (F.col("id") * 4 + 6).cast("int").alias("stop"))
    assert spans.overlap_join(cuts, long, ["doc_id"]).count() == 599_999


def test_boxes_meet_in_cells(spark):
    rng = random.Random(5)
    rows = [(p, i, i % 4 == 0, x, y, x + rng.choice((0.0, 3.0, 9.0, 90.0)), y + rng.choice((2.0, 8.0, 40.0))) for p in range(2) for i in range(150) for x, y in [(rng.randrange(-40, 200) / 2, rng.randrange(-40, 200) / 2)]]
    table = spark.createDataFrame(rows, "page int, name int, gone boolean, x0 double, y0 double, x1 double, y1 double")
    over = lambda r, k: min(r[5], k[5]) - max(r[3], k[3]) > 0.5 and min(r[6], k[6]) - max(r[4], k[4]) > 0.5
    want = sorted(k[:2] for k in rows if not k[2] and any(r[2] and r[0] == k[0] and over(r, k) for r in rows))
    for cell in (3.0, 32.0, 1e6):
        got = spans.box_conflicts(table.filter("gone"), table.filter("not gone"), ["page"], "name", 2.0, cell).collect()
        assert sorted(map(tuple, got)) == want and want
    grid = spark.range(100_000).select(F.lit(1).alias("page"), F.col("id").alias("name"), (F.col("id") % 300 * 10).cast("double").alias("x0"), (F.floor(F.col("id") / 300) * 10).cast("double").alias("y0"))
    grid = grid.withColumn("x1", F.col("x0") + 9).withColumn("y1", F.col("y0") + 9)
    assert spans.box_conflicts(grid.filter("name % 2 = 0").withColumn("x1", F.col("x1") + 5), grid.filter("name % 2 = 1"), ["page"], "name", 2.0).count() == 50_000


def test_decisions_return_to_their_segments(spark):
    segments = spark.createDataFrame([(1, 0, "a", "ab"), (1, 1, "b", ""), (1, 2, "c", "😀d"), (2, 0, "a", "xyz")], "doc int, ord int, segment_id string, text string")
    asked = [(1, 0, 2, "p"), (1, 0, 2, "p"), (1, 1, 3, "over"), (1, 4, 6, "q"), (1, 4, 7, "r"), (1, 7, 9, "out"), (1, 3, 3, "none"), (2, 1, 2, "s"), (3, 0, 1, "lost")]
    got = spans.restored(spark.createDataFrame(asked, "doc int, start int, stop int, type string"), segments, "doc", "ord").collect()
    want = [(1, "a", 0, 2, "p"), (1, "a", 0, 2, "p"), (1, None, None, None, "over"), (1, "c", 0, 2, "q"), (1, "c", 0, 3, "r"), (1, None, None, None, "out"), (1, None, None, None, "none"), (2, "a", 1, 2, "s"), (3, None, None, None, "lost")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_regions_and_expansion(spark):
    rows = dets(spark, [(1, "RRN", 0, 5), (1, "PHONE", 4, 9), (1, "DATE", 20, 22)]).withColumn("chunk", F.lit(0)).withColumn("clipped", F.col("ord") == 0)
    found = spans.regions(rows, ["doc_id"])
    out = sorted((r.start, r.stop, r.type, len(r.constituents or [])) for r in found.collect())
    assert out == [(0, 9, "PHONE", 2), (20, 22, "DATE", 0)]
    assert sorted((r.start, r.stop) for r in spans.expand(found).collect()) == [(0, 5), (4, 9), (20, 22)]
    assert all(r.ok for r in found.select(spans.region_is_sound().alias("ok")).collect())


def test_preview_and_scalars(spark):
    rows = [("EMAIL", "ab@c.de", "ab•••@c.de"), ("EMAIL", "abcdefg@c.de", "ab•••••@c.de"), ("PHONE", "010-1234-5678", "•••-••••-5678"), ("SECRET", "abcdefgh", "abc•••••"), ("PERSON", "abcd", "••••"), ("PERSON", "abcdefgh", "ab••••gh")]
    df = spark.createDataFrame(rows, "t string, v string, want string")
    assert all(r.got == r.want for r in df.select("want", X.preview("v", "t").alias("got")).collect())
    one = spark.createDataFrame([("😀김", "A.B.TXT", "https://X.example:443/a?b")], "s string, name string, url string")
    r = one.select(X.u16len("s").alias("n"), X.u16slice("s", F.lit(2), F.lit(3)).alias("c"), X.splits_pair("s", F.lit(1)).alias("p"), X.safe_boundary("s", F.lit(1), True).alias("b"), X.extension("name").alias("e"), X.origin("url").alias("o")).first()
    assert tuple(r) == (3, "김", True, 2, "txt", "https://x.example")


def test_chunk_windows(spark):
    for n, want in ((0, []), (512, [(0, 512)]), (513, [(0, 512), (384, 513)]), (896, [(0, 512), (384, 896)]), (900, [(0, 512), (384, 896), (768, 900)])):
        got = spark.range(1).select(tokens.chunk_windows(F.lit(n)).alias("w")).first().w
        assert [(w.token_start, w.token_stop) for w in got] == want


def test_bio_orphans_and_pairs(spark):
    labels = ["O", "B-PERSON", "I-PERSON", "B-PHONE", "I-PHONE"]
    rows = [(1, 0, i, i, i + 1, 1, 0, [3.0 if c == k else 0.0 for c in range(5)], False, False, 0, "abcdefg") for i, k in enumerate((2, 2, 0, 1, 1, 3, 4))]
    df = spark.createDataFrame(rows, "doc_id int, chunk int, i int, start int, stop int, attn int, special int, logits array<double>, has_previous boolean, has_next boolean, token_start int, text string")
    got = sorted((r.start, r.stop, r.type) for r in tokens.decode_bio(df.drop("text"), labels, ["doc_id"], df.select("doc_id", "text").distinct()).collect())
    assert got == [(0, 2, "PERSON"), (3, 4, "PERSON"), (4, 5, "PERSON"), (5, 7, "PHONE")]


def view(kind, a, b, c=0.9, chunk=0, s=False, e=False, scores=None):
    return {"type": kind, "confidence": c, "start": a, "stop": b, "chunk": chunk, "truncated_start": s, "truncated_stop": e, "tokens": scores}


def test_merge_views():
    got = greedy.merge_views([view("PERSON", 10, 12, 0.99, 0, e=True), view("PERSON", 10, 20, 0.8, 1), view("PERSON", 10, 20, 0.95, 2), view("PERSON", 18, 20, 0.7, 3, s=True)])
    assert [(e.start, e.stop, e.confidence) for e in got] == [(10, 20, 0.95)]
    got = greedy.merge_views([view("PERSON", 0, 10, 0.9, 0, e=True), view("PERSON", 8, 20, 0.9, 1, s=True), view("PERSON", 20, 30, 0.8, 1)])
    assert sorted((e.start, e.stop) for e in got) == [(0, 20), (20, 30)]
    left = [{"token_index": i, "confidence": c} for i, c in ((0, 0.6), (1, 0.7), (2, 0.8))]
    right = [{"token_index": i, "confidence": c} for i, c in ((2, 0.9), (3, 1.0))]
    (one,) = greedy.merge_views([view("PERSON", 0, 3, 0.7, 0, e=True, scores=left), view("PERSON", 2, 4, 0.95, 1, s=True, scores=right)])
    assert (one.start, one.stop) == (0, 4) and abs(one.confidence - (0.6 + 0.7 + 0.9 + 1) / 4) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["PERSON", "PHONE"]), st.integers(0, 40), st.integers(1, 15), st.integers(0, 3), st.booleans(), st.booleans()), max_size=12))
def test_merged_views_cover_what_the_candidates_cover(rows):
    views = [view(k, a, a + n, 0.5 + a / 100, c, s, e) for k, a, n, c, s, e in rows]
    cover = lambda xs: {i for a, b in xs for i in range(a, b)}
    assert cover((e.start, e.stop) for e in greedy.merge_views(views)) == cover((v["start"], v["stop"]) for v in views)


def test_masking_ignores_input_order(spark):
    rng, text = random.Random(3), "abcdefghijklmnopqrstuvwxyz" * 3
    rows = [("PERSON", a, a + 1 + rng.randrange(9)) for a in rng.sample(range(60), 12)]
    want = masked(spark, text, rows)
    rng.shuffle(rows)
    assert masked(spark, text, rows) == want


def asked_of(spark):
    segments = spark.createDataFrame([(1, "s", "abcdefghij"), (1, "t", "clean")], "doc_id long, segment_id string, text string")
    rows = dets(spark, [(1, "RRN", 0, 5), (1, "PHONE", 3, 10)]).withColumn("segment_id", F.lit("s"))
    return segments, review.request(segments, rows)


def test_review_resolves_whole_documents(spark):
    segments, asked = asked_of(spark)
    masks, rejects = review.resolve(asked, mask_documents.approve_automatic(asked), segments)
    assert {r.segment_id: [tuple(s) for s in r.spans] for r in masks.collect()} == {"s": [(0, 10)], "t": []}
    assert rejects.count() == 0


@pytest.mark.parametrize("change", ["omitted", "forged", "moved", "regrouped"])
def test_review_rejects(spark, change):
    segments, asked = asked_of(spark)
    made = mask_documents.approve_automatic(asked)
    first = F.col("type") == "RRN"
    if change == "omitted":
        made = made.filter(~first)
    elif change == "forged":
        made = made.withColumn("word", F.when(first, "x").otherwise(F.col("word")))
    elif change == "moved":
        made = made.withColumn("stop", F.when(first, 4).otherwise(F.col("stop")))
    else:
        made = made.withColumn("grp", F.lit("confirm_masking"))
    masks, rejects = review.resolve(asked, made, segments)
    assert masks.count() == 0 and [r.doc_id for r in rejects.collect()] == [1]


def test_preferences(spark):
    stored = spark.createDataFrame([("PERSON", "AUTO_MASK"), ("RRN", "nonsense"), ("NOSUCH", "CONFIRM")], "type string, policy string")
    out = {r.type: r.policy for r in policy.normalised(stored, spark).collect()}
    assert len(out) == 18 and out["PERSON"] == "AUTO_MASK" and out["RRN"] == "AUTO_MASK" and out["DATE"] == "CONFIRM"


def test_error_codes(spark):
    rows = [("DOCX: input size limit exceeded", "DOCUMENT_LIMIT"), ("DOCX: tracked change", "DOCUMENT_FORMAT"), ("HWPX: bad", "DOCUMENT_FAILED"), ("PDF requires OCR", "PDF_OCR_REQUIRED"), ("session closed", "DOCUMENT_SESSION"), ("Worker died", "DOCUMENT_WORKER")]
    df = spark.createDataFrame(rows, "m string, want string").select("want", X.error_code("m").alias("got"))
    assert all(r.got == r.want for r in df.collect())


# ---- files ----

W = office.WORD


PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def part_kind(name):
    return re.sub(r"\d*\.xml$", "", name.rpartition("/")[2])


def relations(*targets):
    return f"<Relationships xmlns='{PACKAGE}/relationships'>" + "".join(f"<Relationship Id='rId{k}' Type='{OFFICE}/{'officeDocument' if part_kind(t) == 'document' else part_kind(t)}' Target='{t}'/>" if ":" not in t else f"<Relationship Id='r{k}' Type='{OFFICE}/hyperlink' Target='{t}' TargetMode='External'/>" for k, t in enumerate(targets)) + "</Relationships>"


def docx(body, extra=None, related=()):
    """extra: more parts; related: targets of the document's own relationships."""
    parts = {"_rels/.rels": relations("word/document.xml", "docProps/core.xml"), "word/document.xml": f"<w:document xmlns:w='{W}'><w:body>{body}</w:body></w:document>", **(extra or {})}
    if related:
        parts["word/_rels/document.xml.rels"] = relations(*related)
    listed = "".join(f"<Override PartName='/{n}' ContentType='application/x.{'document.main' if part_kind(n) == 'document' else part_kind(n)}+xml'/>" for n in parts if not n.endswith(".rels"))
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f"<Types xmlns='{PACKAGE}/content-types'><Default Extension='rels' ContentType='x'/><Default Extension='png' ContentType='image/png'/>{listed}</Types>")
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def para(*runs):
    return "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


SPLIT = para("<w:t>😀 김</w:t>", "<w:tab/><w:t>민</w:t><w:br/>", "<w:t>수</w:t><w:br/><w:t> safe</w:t>")


def test_docx_segments_and_masks():
    p = package  # the module's limits are the defaults
    opened = office.Package("docx", docx(SPLIT + para()), S.PACKAGE_LIMITS)
    assert [s.text for s in opened.segments] == ["😀 김\t민\n수\n safe", ""]
    first, second = (s.segment_id for s in opened.segments)
    data = opened.masked({first: [(3, 8)], second: []})
    again = office.Package("docx", data, S.PACKAGE_LIMITS)
    assert again.segments[0].text == "😀 █████\n safe"
    with pytest.raises(p.Refused):
        office.Package("docx", docx(SPLIT), S.PACKAGE_LIMITS).masked({first: [(1, 2)]})


@pytest.mark.parametrize("body", ["<!DOCTYPE a>", "<w:p><w:ins/></w:p>", "<w:p><w:r><w:drawing/></w:r></w:p>", "<w:r><w:t>out</w:t></w:r>", "<w:p>"])
def test_docx_refusals(body):
    with pytest.raises(package.Refused):
        office.Package("docx", docx(para("<w:t>x</w:t>") + body), S.PACKAGE_LIMITS)


MATH = "http://schemas.openxmlformats.org/officeDocument/2006/math"
GOOD = para("<w:t>text</w:t>")


@pytest.mark.parametrize(
    "data",
    [
        docx(GOOD + f"<w:p><m:oMath xmlns:m='{MATH}'><m:r><m:t>a@b.example.com</m:t></m:r></m:oMath></w:p>"),
        docx(GOOD + "<w:p>stray a@b.example.com</w:p>"),
        docx(GOOD + "<w:p><w:r><w:t>x<w:b/></w:t></w:r></w:p>"),
        docx(GOOD + "<w:p><w:pPr><w:jc>text</w:jc></w:pPr></w:p>"),
        docx(GOOD + "<w:p><w:pPr><w:pPrChange/></w:pPr></w:p>"),
        docx(GOOD + "<w:tbl><w:tblPr><w:tblCaption w:val='a@b.example.com'/></w:tblPr></w:tbl>"),
        docx(GOOD, {"word/glossary/document.xml": "<x/>"}, ["glossary/document.xml"]),
        docx(GOOD, {"word/embeddings/o.bin": "x"}, ["embeddings/o.bin"]),
        docx(GOOD, {"word/charts/chart1.xml": "<c/>"}, ["charts/chart1.xml"]),
        docx(GOOD, {"word/media/i.png": "x"}),
        docx(GOOD, related=["mailto:a@b.example.com"]),
        docx(GOOD, related=["../../outside.xml"]),
        docx(GOOD, related=["header9.xml"]),
        docx(GOOD, {"_rels/.rels": relations("docProps/core.xml"), "docProps/core.xml": "<x/>"}),
        docx(GOOD, {"word/styles.xml": f"<w:styles xmlns:w='{W}'>words</w:styles>"}, ["styles.xml"]),
    ],
)
def test_docx_fails_closed(data):
    with pytest.raises(package.Refused):
        office.Package("docx", data, S.PACKAGE_LIMITS)


STYLES, NUMBERS = f"<w:styles xmlns:w='{W}'>%s</w:styles>", f"<w:numbering xmlns:w='{W}'><w:abstractNum w:abstractNumId='0'><w:lvl w:ilvl='0'>%s</w:lvl></w:abstractNum></w:numbering>"


@pytest.mark.parametrize(
    ("body", "extra", "kept"),
    [
        (GOOD, {"word/numbering.xml": NUMBERS % "<w:lvlText w:val='Jane Doe 010-1234-5678'/>"}, None),
        (GOOD, {"word/numbering.xml": NUMBERS % "<w:numFmt w:val='decimal'/><w:lvlText w:val='(%1.%2)'/>"}, ["w:val=\"(%1.%2)\"", "w:val=\"decimal\""]),
        (GOOD, {"word/styles.xml": STYLES % "<w:style w:styleId='Jane' w:type='paragraph'><w:name w:val='Jane Doe'/><w:aliases w:val='Jane'/><w:basedOn w:val='JaneDoe2'/><w:pPr><w:jc w:val='center'/></w:pPr></w:style>"}, ["w:styleId=\"s1\"", "w:val=\"s2\"", "w:val=\"center\""]),
        ("<w:p><w:pPr><w:pStyle w:val='Jane'/><w:jc w:val='Jane'/><w:ind w:left='720'/></w:pPr><w:r><w:t>text</w:t></w:r></w:p>", {}, ["w:val=\"s1\"", "w:left=\"720\""]),
        ("<w:p><w:pPr><w:jane w:val='Jane'><w:x/></w:jane><w:jc w:Jane='1' w:val='left'/></w:pPr><w:r><w:rPr><w:rFonts w:ascii='Jane Doe' w:cs='Arial'/></w:rPr><w:t w:jane='Jane' xml:space='preserve'>text</w:t></w:r></w:p>", {}, ["w:val=\"left\"", "w:cs=\"Arial\"", "xml:space=\"preserve\""]),
        ("<w:p w:rsidR='Jane'><w:commentRangeStart w:id='1'/><w:r><w:t>text</w:t><w:commentReference w:id='1'/></w:r><w:commentRangeEnd w:id='1'/></w:p>", {}, []),
    ],
)
def test_docx_formatting_says_nothing(body, extra, kept):
    data = docx(body, extra, [n.removeprefix("word/") for n in extra])
    if kept is None:
        with pytest.raises(package.Refused):
            office.Package("docx", data, S.PACKAGE_LIMITS)
        return
    opened = office.Package("docx", data, S.PACKAGE_LIMITS)
    with zipfile.ZipFile(BytesIO(opened.masked({s.segment_id: [] for s in opened.segments}))) as z:
        everything = b"".join(z.read(n) for n in z.namelist()).decode()
    assert "jane" not in everything.lower() and "comment" not in everything and all(k in everything for k in kept), everything


def test_docx_hyphens_are_text():
    opened = office.Package("docx", docx(para("<w:t>010</w:t>", "<w:noBreakHyphen/><w:t>1234</w:t>", "<w:noBreakHyphen/><w:t>5678</w:t><w:softHyphen/>")), S.PACKAGE_LIMITS)
    (one,) = opened.segments
    assert one.text == "010-1234-5678\u00ad"
    again = office.Package("docx", opened.masked({one.segment_id: [(0, 13)]}), S.PACKAGE_LIMITS)
    assert again.segments[0].text == "█" * 13 + "\u00ad"


def test_docx_parts_are_what_they_are_called():
    header = f"<w:hdr xmlns:w='{W}'>{para('<w:t>head</w:t>')}</w:hdr>"
    good = docx(GOOD, {"word/header1.xml": header}, ["header1.xml"])
    assert len(office.Package("docx", good, S.PACKAGE_LIMITS).segments) == 2
    for old, new in ((b"/header'", b"/footer'"), (b"x.header+xml", b"x.styles+xml"), (b"Id='rId0' Type='http://schemas.openxmlformats.org/officeDocument/2006/relationships/header'", b"Id='Jane' Type='http://schemas.openxmlformats.org/officeDocument/2006/relationships/header'")):
        with zipfile.ZipFile(BytesIO(good)) as z:
            parts = {n: z.read(n) for n in z.namelist()}
        assert any(old in x for x in parts.values())
        out = BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, x in parts.items():
                z.writestr(n, x.replace(old, new))
        with pytest.raises(package.Refused):
            office.Package("docx", out.getvalue(), S.PACKAGE_LIMITS)


def test_docx_keeps_what_is_reached_and_names_nothing_else():
    header = f"<w:hdr xmlns:w='{W}'>{para('<w:t>head</w:t>')}</w:hdr>"
    extra = {"word/header1.xml": header, "word/header2.xml": header, "word/styles.xml": f"<w:styles xmlns:w='{W}'><w:style/></w:styles>", "docProps/core.xml": "<c>secret name</c>", "customXml/item1.xml": "<c>secret</c>", "word/comments.xml": "<c>secret</c>", "word/settings.xml": "<c>secret</c>", "word/theme/theme1.xml": "<c/>"}
    data = docx(f"<w:bookmarkStart w:name='secret'/>{GOOD}<w:sectPr/>", extra, ["header1.xml", "styles.xml", "/word/comments.xml", "settings.xml", "theme/theme1.xml"])
    opened = office.Package("docx", data, S.PACKAGE_LIMITS)
    assert [s.text for s in opened.segments] == ["text", "head"]
    out = opened.masked({s.segment_id: [] for s in opened.segments})
    with zipfile.ZipFile(BytesIO(out)) as z:
        names = set(z.namelist())
        assert names == {"[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/_rels/document.xml.rels", "word/header1.xml", "word/styles.xml"}
        everything = b"".join(z.read(n) for n in names).decode()
        listed = z.read("[Content_Types].xml").decode()
    assert "secret" not in everything and not any(x in everything for x in ("comments", "settings", "theme1", "docProps", "header2"))
    assert "/word/header1.xml" in listed and "png" not in listed


def test_one_bad_file_costs_a_reject_row_and_no_other(spark):
    rows = [("good", docx(GOOD)), ("odd", docx(GOOD + "<w:p><w:r><w:t>x<w:b/></w:t></w:r></w:p>")), ("none", None), ("zip", b"zz")]
    files = spark.createDataFrame([(d, c and bytearray(c)) for d, c in rows], "doc_id string, content binary")
    texts, rejects = office.segments(files, "docx")
    assert [(r.doc_id, r.text) for r in texts.collect()] == [("good", "text")]
    assert {r.doc_id: r.code for r in rejects.collect()} == {"odd": "DOCUMENT_FORMAT", "none": "DOCUMENT_FAILED", "zip": "DOCUMENT_FAILED"}


def test_zip_refusals():
    good = docx(para("<w:t>text</w:t>"))
    assert len(package.directory(good, S.PACKAGE_LIMITS)) == 3
    at = good.index(b"PK\x01\x02")
    broken = [good[:-1], good[:30] + b"x" + good[31:], b"nozip", good + b"tail", good[: at + 16] + b"\0\0\0\0" + good[at + 20 :]]
    for data in broken:
        with pytest.raises(package.Refused):
            package.parts(data, S.PACKAGE_LIMITS)
    for name in ("../x", "/abs", "a\\b", "WORD/document.xml"):
        with pytest.raises(package.Refused):
            package.parts(docx(para("<w:t>t</w:t>"), {name: "x"}), S.PACKAGE_LIMITS)
    with pytest.raises(package.Refused):
        package.directory(good, S.PACKAGE_LIMITS | {"entries": 1})


def hwpx():
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/hwp+zip")
        for n, text in ((10, "열째"), (2, "mail a@b.example.com now")):
            z.writestr(f"Contents/section{n}.xml", f"<s xmlns:hp='{office.HANGUL}'><hp:p><hp:t>{text}</hp:t></hp:p><hp:p/></s>")
    return out.getvalue()


def test_office_flows(spark):
    files = spark.createDataFrame([("h", bytearray(hwpx())), ("bad", bytearray(b"zz"))], "doc_id string, content binary")
    done, rejects = mask_documents.mask_office(files, "hwpx")
    (one,) = done.collect()
    texts = [s.text for s in office.Package("hwpx", bytes(one.content), S.PACKAGE_LIMITS).segments]
    assert texts == ["mail " + S.BLOCK * len("a@b.example.com") + " now", "열째"]
    assert [tuple(r) for r in rejects.collect()] == [("bad", "extracting", "DOCUMENT_FAILED")]


def test_text_files(spark):
    rows = [("a", "a.txt", b"\xef\xbb\xbf\xf0\x9f\x98\x80 x@y.example.org\n"), ("b", "b.csv", b"x"), ("c", "c.md", b"\xc3\x28"), ("d", "d.md", b"A\0B"), ("e", "e.MD", b"clean")]
    files = spark.createDataFrame([(i, n, len(c), bytearray(c)) for i, n, c in rows], "doc_id string, name string, length long, content binary")
    done, rejects = mask_documents.mask_text_files(files)
    out = {r.doc_id: (r.name, bytes(r.content)) for r in done.collect()}
    assert out == {"a": ("masked-document.txt", b"\xef\xbb\xbf" + ("😀 " + S.BLOCK * 15 + "\n").encode()), "e": ("masked-document.md", b"clean")}
    assert {r.doc_id for r in rejects.collect()} == {"b", "c", "d"}
    assert textfile.scan(files, {"input_bytes": 3})[1].filter("code = 'DOCUMENT_LIMIT'").count() == 2


def test_rules_in_utf16(spark):
    df = spark.createDataFrame([(1, "😀 a@b.example.com 😀 c@d.example.com")], "doc_id long, text string")
    assert sorted((r.start, r.stop) for r in detect.by_rules(df, ["doc_id"]).collect()) == [(3, 18), (22, 37)]


def test_hwpx_previews_go():
    out = BytesIO(hwpx())
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("Preview/PrvText.txt", "secret")
        z.writestr("META-INF/container.xml", "<c xmlns='urn:c'><r full-path='Contents/content.hpf'/><r full-path='Preview/PrvText.txt'/></c>")
    opened = office.Package("hwpx", out.getvalue(), S.PACKAGE_LIMITS)
    with zipfile.ZipFile(BytesIO(opened.masked({s.segment_id: [] for s in opened.segments}))) as z:
        assert not [n for n in z.namelist() if n.startswith("Preview")] and b"Preview" not in z.read("META-INF/container.xml") and b"content.hpf" in z.read("META-INF/container.xml")


def test_units_before_and_spans_meet_texts_without_a_shuffle(spark):
    one = spark.createDataFrame([("a\U0001f600b\U0001f600", [4, 0, 2, 2]), ("abc", [3]), ("", [0]), (None, [1])], "s string, at array<int>")
    assert [r.m for r in one.select(X.units_before("s", F.col("at")).alias("m")).collect()] == [{0: 0, 2: 3, 4: 6}, {3: 3}, {0: 0}, {1: None}]
    for name in ("mask_alias_pairs", "mask_block_pairs"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_decoding_moves_no_token_between_tasks(spark):
    plan = queries.QUERIES["bio_decode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window") :]
    dealt = next(line for line in below.splitlines() if "Exchange" in line)
    assert "REPARTITION_BY_NUM" in dealt and plan.index("Generate") < plan.index(dealt)
    one = spark.createDataFrame([([0.5, 2.0, 1.0],), ([1.0, 1.0],), ([3.0, 1.0, 2.0, 0.0],)], "v array<double>")
    assert all(r.a == r.b for r in one.select(X.softmax_of("v", 3).alias("a"), X.softmax_max("v").alias("b")).collect())
