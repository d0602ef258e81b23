"""What of a word-processing package is kept: parts that a relationship reaches, of known kinds, holding known elements only.

Everything that could carry text past the masks is either dropped with all that names it (properties, comments, settings,
themes, custom data) or refuses the file (objects, charts, media, formulas, external targets, stray text). Formatting stays
where its names are known and its values are numbers, switches, colours or words of the format; what else there is of it goes:
a document may look plainer, but it says nothing more. Style names go, style ids are numbered.
"""

from __future__ import annotations

import posixpath
import re
from collections import deque
from xml.dom.minidom import Element, Node

from .package import Refused, parse

# Fixed values of the format: namespaces, and what each kind of part and element is.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RELATED = "http://schemas.openxmlformats.org/package/2006/relationships"
REFERENCE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
XML, XMLNS = "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"
TYPES_PART, ROOT_RELATIONS, MAIN = "[Content_Types].xml", "_rels/.rels", "word/document.xml"
TEXT_PARTS = re.compile(r"word/(?:document|header\d+|footer\d+|footnotes|endnotes)\.xml")
STYLE_PARTS = re.compile(r"word/(?:styles|numbering)\.xml")
DROPPED_PARTS = re.compile(r"docProps/.+|customXml/.+|word/(?:people|comments\w*|settings|webSettings|fontTable)\.xml|word/theme/theme\d+\.xml|word/_rels/(?:settings|fontTable|webSettings|comments\w*)\.xml\.rels", re.I)
RELATION_PARTS = re.compile(r"_rels/\.rels|word/_rels/[^/]+\.xml\.rels")

#: Elements of the text: those that hold others, those of a run, and marks without content.
HOLDERS = frozenset("document body hdr ftr footnotes footnote endnotes endnote p r tbl tr tc".split())
IN_RUN = frozenset("t tab br cr noBreakHyphen softHyphen".split())
MARKS = frozenset("separator continuationSeparator footnoteReference endnoteReference footnoteRef endnoteRef lastRenderedPageBreak".split())
#: What runs hold as text without a text element.
HYPHENS = {"noBreakHyphen": "-", "softHyphen": "\u00ad"}
#: Formatting: whatever stands below is formatting too, and has no text.
FORMATS = frozenset("pPr rPr tblPr tblGrid tblPrEx trPr tcPr sectPr".split())
#: Removed wherever they stand: their names are free text, and nothing depends on them.
REMOVED = frozenset("bookmarkStart bookmarkEnd proofErr permStart permEnd commentRangeStart commentRangeEnd commentReference annotationRef".split())
#: Formatting that is kept, by what it formats.
KEPT = frozenset(
    """b bCs i iCs u strike dstrike caps smallCaps vanish color sz szCs highlight shd bdr vertAlign position kern w em lang rtl cs rFonts rStyle outline shadow
    jc ind spacing tabs tab pBdr keepNext keepLines pageBreakBefore widowControl contextualSpacing outlineLvl numPr ilvl numId pStyle bidi textAlignment textDirection
    top bottom left right start end insideH insideV between bar tl2br tr2bl
    tblStyle tblW tblInd tblBorders tblLayout tblLook tblCellMar tblCellSpacing gridCol tcW gridSpan vMerge tcBorders tcMar vAlign noWrap cantSplit trHeight tblHeader
    pgSz pgMar pgNumType cols col docGrid titlePg type headerReference footerReference footnotePr endnotePr numFmt numStart numRestart pos lnNumType""".split()
)
#: The same of the style and numbering parts.
KEPT_IN_STYLES = KEPT | FORMATS | frozenset("styles style docDefaults rPrDefault pPrDefault basedOn next link qFormat uiPriority semiHidden unhideWhenUsed tblStylePr numbering abstractNum num abstractNumId lvl lvlText lvlJc suff multiLevelType nsid tmpl styleLink numStyleLink lvlOverride startOverride isLgl lvlRestart".split())
ATTRIBUTES = frozenset(
    """val color sz space fill themeColor line lineRule before after beforeAutospacing afterAutospacing left right start end firstLine hanging leftChars firstLineChars w h type hRule orient top bottom header footer gutter num equalWidth sep linePitch
    pos leader ascii hAnsi eastAsia cs hint bidi id fmt clear customMarkFollows firstRow lastRow firstColumn lastColumn noHBand noVBand styleId default customStyle ilvl abstractNumId numId tplc""".split()
)
STYLE_IDS = {"pStyle": "val", "rStyle": "val", "tblStyle": "val", "basedOn": "val", "next": "val", "link": "val", "styleLink": "val", "numStyleLink": "val", "style": "styleId"}
#: Words that values may be.
WORDS = frozenset(
    """true false on off none nil auto single double dotted dashed thick wave words clear start end left right center both distribute decimal top bottom baseline superscript subscript
    black blue cyan green magenta red yellow white darkBlue darkCyan darkGreen darkMagenta darkRed darkYellow darkGray lightGray
    exact atLeast page column textWrapping line all portrait landscape nextPage continuous evenPage oddPage even odd first default separator continuationSeparator
    lowerLetter upperLetter lowerRoman upperRoman bullet ordinal ganada chosung hyphen dot underscore middleDot heavy fixed autofit pct dxa restart continue lines linesAndChars tab nothing
    singleLevel multilevel hybridMultilevel paragraph character table numbering lrTb tbRl btLr eastAsia default firstRow lastRow firstCol lastCol band1Horz band2Horz band1Vert band2Vert""".split()
)
FONTS = frozenset(["Arial", "Calibri", "Cambria", "Courier New", "Georgia", "Symbol", "Tahoma", "Times New Roman", "Verdana", "Wingdings", "맑은 고딕", "바탕", "굴림", "돋움", "Malgun Gothic", "Batang"])
PLAIN = re.compile(r"-?[0-9]{1,5}(?:\.[0-9]{1,3})?(?:pt|cm|mm|in|pc|%)?|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8}(?![0-9A-Fa-f])|[a-z]{2}-[A-Z]{2}|s[0-9]{1,5}")
RELATION_ID = re.compile(r"r(?:Id)?[0-9a-f]{1,32}", re.I)
#: Kinds of kept parts: the last words of their relationship and content types.
PART_KINDS = {"document": ("officeDocument", "document.main+xml")} | {k: (k, f"{k}+xml") for k in ("header", "footer", "footnotes", "endnotes", "styles", "numbering")}
#: Formatting that records changes or carries captions.
NEVER = re.compile(r"\w+Change|ins|del|move(?:From|To)\w*|cellIns|cellDel|cellMerge|tblCaption|tblDescription|docPartObj|sdt\w*|dataBinding|object|pict|drawing")


def refuse(what: str) -> None:
    raise Refused(f"DOCX: {what}")


def kind_of(part: str) -> str:
    return re.sub(r"\d+$", "", posixpath.basename(part).removesuffix(".xml"))


def is_plain(e: Element, a, styles: dict[str, str]) -> bool:
    """Whether an attribute says nothing that its format does not: style ids get their numbers here."""
    if a.namespaceURI == XMLNS or a.name == "xmlns":
        return True
    if a.namespaceURI == XML:
        return a.localName == "space" and a.value in ("default", "preserve")
    if a.namespaceURI == REFERENCE:
        return a.localName == "id" and RELATION_ID.fullmatch(a.value) is not None
    if STYLE_IDS.get(e.localName) == a.localName:
        a.value = styles.setdefault(a.value, f"s{len(styles) + 1}")
        return True
    if e.localName == "lvlText" and a.localName == "val":
        rest = re.sub(r"%[1-9]", "", a.value)
        return len(rest) <= 1 or (len(rest) < 8 and not re.search(r"\w", rest))
    if a.localName not in ATTRIBUTES or e.localName in ("t", "p", "r", "tr", "tc", "tbl"):
        return False
    if e.localName == "rFonts":
        return a.value in FONTS or a.value in WORDS
    return a.value in WORDS or PLAIN.fullmatch(a.value) is not None


def check_element(e: Element, formatting: bool, styles: dict[str, str]) -> None:
    """Refuses what is not known; takes off attributes that are no plain formatting, and those of other vocabularies, which are hints for editors."""
    if e.namespaceURI != WORD or NEVER.fullmatch(e.localName):
        refuse("unsupported content")
    if not formatting and e.localName not in HOLDERS | IN_RUN | MARKS | FORMATS:
        refuse("unsupported content")
    for a in [e.attributes.item(k) for k in range(e.attributes.length)]:
        if not is_plain(e, a, styles):
            if e.localName == "lvlText":
                refuse("free text in numbering")
            if a.localName == "id" and not formatting:
                refuse("unsupported id")
            e.removeAttributeNode(a)


def check_text_part(document, styles: dict[str, str]) -> None:
    """Known elements only, text in text elements of runs only, nothing but text in those."""
    pending = deque([(document.documentElement, False)])
    while pending:
        e, formatting = pending.popleft()
        check_element(e, formatting, styles)
        in_run = e.parentNode.nodeType == Node.ELEMENT_NODE and e.parentNode.localName == "r"
        if e.localName in IN_RUN and not formatting and not in_run:
            refuse("text outside a run")
        below = formatting or e.localName in FORMATS
        for c in list(e.childNodes):
            if c.nodeType == Node.ELEMENT_NODE:
                if c.namespaceURI == WORD and (c.localName in REMOVED or (below and c.localName not in KEPT | FORMATS and not NEVER.fullmatch(c.localName))):
                    e.removeChild(c)
                elif e.localName in IN_RUN and not formatting:
                    refuse("unsupported content in text")
                else:
                    pending.append((c, below))
            elif c.data.strip() and (below or e.localName != "t"):
                refuse("stray text")


def check_style_part(document, styles: dict[str, str]) -> None:
    pending = [document.documentElement]
    while pending:
        e = pending.pop()
        check_element(e, True, styles)
        for c in list(e.childNodes):
            if c.nodeType == Node.ELEMENT_NODE:
                if c.namespaceURI == WORD and c.localName not in KEPT_IN_STYLES and not NEVER.fullmatch(c.localName):
                    e.removeChild(c)
                else:
                    pending.append(c)
            elif c.data.strip():
                refuse("stray text")


def relations_of(part: str) -> str:
    folder, name = posixpath.split(part)
    return posixpath.join(folder, "_rels", f"{name}.rels") if part else ROOT_RELATIONS


def target_of(part: str, target: str) -> str:
    """The part that a relationship of another part points at; outside the package there is none."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", target) or "\\" in target or "%" in target or "?" in target:
        refuse("unsupported relationship target")
    found = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(part), target.split("#")[0]))
    if found.startswith("..") or found == ".":
        refuse("unsupported relationship target")
    return found


def relationships(contents: dict[str, bytes], part: str, limits: dict) -> tuple:
    """A part's relationship document and its elements with their targets; those to dropped parts fall away."""
    name = relations_of(part)
    if name not in contents:
        return None, {}
    document, kept = parse(contents[name], limits), {}
    for e in document.getElementsByTagName("*"):
        if e is document.documentElement:
            continue
        if e.namespaceURI != RELATED or e.localName != "Relationship" or e.getAttribute("TargetMode") not in ("", "Internal"):
            refuse("unsupported relationship")
        target = target_of(part, e.getAttribute("Target"))
        if target in contents:
            if e.getAttribute("Type").rpartition("/")[2] != PART_KINDS.get(kind_of(target), (None,))[0] or not RELATION_ID.fullmatch(e.getAttribute("Id")):
                refuse("a relationship of another type than its part")
            kept[e] = target
        elif not DROPPED_PARTS.fullmatch(target):
            refuse("a relationship without its part")
    for e in [x for x in document.documentElement.childNodes if x not in kept]:
        document.documentElement.removeChild(e)
    return document, kept


def closed(contents: dict[str, bytes], limits: dict, styles: dict[str, str]) -> tuple[dict[str, bytes], list[str]]:
    """(parts that are kept, text parts in order); relationships and content types name the kept parts only, as what they are.

    styles takes the number of each style id.
    """
    for name in contents:
        if not (name == TYPES_PART or DROPPED_PARTS.fullmatch(name) or RELATION_PARTS.fullmatch(name) or TEXT_PARTS.fullmatch(name) or STYLE_PARTS.fullmatch(name) or name.endswith("/")):
            refuse("unsupported part")
    held = {n: x for n, x in contents.items() if not DROPPED_PARTS.fullmatch(n) and not n.endswith("/")}
    if TYPES_PART not in held or MAIN not in held or ROOT_RELATIONS not in held:
        refuse("not a document package")
    reached, pending, out = {""}, deque([""]), {}
    while pending:
        part = pending.popleft()
        document, kept = relationships(held, part, limits)
        if document is not None:
            out[relations_of(part)] = document.toxml(encoding="UTF-8")
        for target in kept.values():
            if target not in reached:
                reached.add(target)
                pending.append(target)
    if MAIN not in reached:
        refuse("not a document package")
    out |= {n: held[n] for n in held if n in reached}
    types = parse(held[TYPES_PART], limits)
    for e in list(types.documentElement.childNodes):
        named = e.getAttribute("PartName").lstrip("/") if e.nodeType == Node.ELEMENT_NODE else ""
        by_end = e.nodeType == Node.ELEMENT_NODE and e.localName == "Default" and e.getAttribute("Extension").lower() in ("rels", "xml")
        if named not in out and not by_end:
            types.documentElement.removeChild(e)
        elif named and not e.getAttribute("ContentType").endswith("." + PART_KINDS.get(kind_of(named), ("", "relationships+xml"))[1]):
            refuse("a part of another content type")
    out = {TYPES_PART: types.toxml(encoding="UTF-8")} | out
    texts = sorted((n for n in out if TEXT_PARTS.fullmatch(n)), key=lambda n: (n != MAIN, n))
    for name in out:
        if STYLE_PARTS.fullmatch(name):
            document = parse(out[name], limits)
            check_style_part(document, styles)
            out[name] = document.toxml(encoding="UTF-8")
    return out, texts
