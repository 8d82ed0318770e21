"""Parsers from file contents to blocks (inventory S7, S9-S12, S15-S19, S32).

A block is (kind, level, text): kind is heading, para, item, code, table or note; level is that of a heading or list item. A table's text is
its rendered rows. Each parser takes bytes; parsed() runs them over (path, content) rows in Arrow batches, a file a row, so that
a task holds one batch of files and nothing moves. Nulls: a null content is an empty file. A file that its parser cannot
read falls back to its decoded text as paragraphs, with the reason in `note`.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.tables import finish, place, render
from tessera.registry import frame

Block = tuple[str, int, str]

# First bytes of the known formats.
MAGIC = [(b"%PDF-", "pdf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole"), (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip")]
# The member of a ZIP that tells its kind.
MEMBERS = [("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx"), ("Contents/content.hpf", "hwpx")]
OLE_EXTENSIONS = {"doc", "xls", "ppt", "hwp"}
# Elements of HTML.
HTML_SKIPPED = {"script", "style", "noscript", "template", "nav", "header", "footer", "head"}
HTML_BLOCKS = {"p", "div", "section", "article", "main", "aside", "blockquote", "pre", "dd", "dt", "figcaption", "br", "ul", "ol", "dl", "form", "body", "html", "hr"}


def decode(content: bytes) -> str:
    """UTF-8 with or without its mark, else CP949, else UTF-8 with replacements."""
    for name in ("utf-8-sig", "cp949"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            pass
    return content.decode("utf-8", "replace")


def detect(content: bytes, extension: str) -> str:
    """What a file is by its first bytes: a format, `empty`, `encrypted`, `mismatch:<format>` where the extension says otherwise, or `text`."""
    if not content:
        return "empty"
    found = next((kind for head, kind in MAGIC if content.startswith(head)), "text")
    if found == "zip":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
            found = next((kind for member, kind in MEMBERS if member in names), "zip")
        except zipfile.BadZipFile:
            return "broken"
    if found == "ole":
        # An encrypted package of an OOXML file is an OLE file with these streams.
        if "EncryptedPackage".encode("utf-16-le") in content:
            return "encrypted"
        return extension if extension in OLE_EXTENSIONS else "mismatch:ole"
    known = {"pdf", "docx", "pptx", "xlsx", "hwpx", *OLE_EXTENSIONS}
    if extension in known and found != extension:
        return f"mismatch:{found}"
    return found


# HTML


#: Fixed values of the HTML standard: larger spans are read as these.
MOST_DOWN, MOST_RIGHT = 65534, 1000


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.kind, self.level = "para", 0
        self.skipped, self.depth = 0, 0
        self.tables: list[dict] = []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.kind, self.level = "para", 0

    def handle_starttag(self, tag, attrs):
        if tag in HTML_SKIPPED:
            self.flush() if not self.skipped and not self.tables else None
            self.skipped += 1
            return
        if self.skipped:
            return
        if tag == "table":
            if not self.tables:
                self.flush()
            self.tables.append({"row": -1, "cells": [], "open": None})
            return
        if self.tables:
            table = self.tables[-1]
            if tag == "tr":
                table["row"] += 1
            elif tag in ("td", "th"):
                spans = {k: int(v) for k, v in attrs if k in ("rowspan", "colspan") and v and v.isdigit() and int(v)}
                table["row"] = max(table["row"], 0)
                table["open"] = (table["row"], min(spans.get("rowspan", 1), MOST_DOWN), min(spans.get("colspan", 1), MOST_RIGHT))
                self.held = []
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "li":
            self.flush()
            self.kind, self.level = "item", max(self.depth, 1)
        elif tag in HTML_BLOCKS:
            # A block that opens inside a heading or an item goes on with it.
            if self.held and "".join(self.held).strip() or self.kind == "para":
                self.flush()
            self.depth += tag in ("ul", "ol")

    def handle_endtag(self, tag):
        if tag in HTML_SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            pass
        elif self.tables:
            table = self.tables[-1]
            if tag in ("td", "th") and table["open"]:
                row, down, right = table["open"]
                table["cells"].append((row, " ".join("".join(self.held).split()), down, right))
                table["open"], self.held = None, []
            elif tag == "table":
                self.tables.pop()
                text = render(finish(place(table["cells"])))
                if self.tables:  # a table inside a cell stays that cell's text
                    self.held.append(text.replace("\n", " "))
                elif text:
                    self.blocks.append(("table", 0, text))
        elif re.fullmatch("h[1-6]", tag) or tag == "li" or tag in HTML_BLOCKS:
            self.flush()
            self.depth = max(0, self.depth - (tag in ("ul", "ol")))

    def handle_data(self, data):
        if not self.skipped:
            self.held.append(data)


def html_blocks_of(content: bytes) -> list[Block]:
    """Headings, paragraphs, list items and tables; navigation, headers, footers, scripts and styles left out."""
    parser = _Html()
    parser.feed(decode(content))
    parser.close()
    parser.flush()
    return parser.blocks


# Markdown and notebooks

_FENCE = re.compile(r"^\s*(```+|~~~+)")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def markdown_blocks_of(text: str) -> list[Block]:
    blocks: list[Block] = []
    held: list[str] = []
    lines = text.splitlines()

    def flush():
        if held:
            blocks.append(("para", 0, " ".join(x.strip() for x in held)))
            held.clear()

    k = 0
    while k < len(lines):
        line = lines[k]
        if fence := _FENCE.match(line):
            flush()
            mark, body = fence[1], []
            k += 1
            while k < len(lines) and not lines[k].strip().startswith(mark):
                body.append(lines[k])
                k += 1
            blocks.append(("code", 0, "\n".join(body)))
        elif heading := _HEADING.match(line):
            flush()
            blocks.append(("heading", len(heading[1]), heading[2]))
        elif "|" in line and k + 1 < len(lines) and "|" in lines[k + 1] and _RULE.match(lines[k + 1]):
            flush()
            rows = [line]
            k += 2
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                rows.append(lines[k])
                k += 1
            cells = [[c.strip() for c in r.strip().strip("|").split("|")] for r in rows]
            blocks.append(("table", 1, render(finish(cells))))
            continue
        elif item := _ITEM.match(line):
            flush()
            blocks.append(("item", len(item[1].expandtabs(4)) // 2 + 1, item[2].strip()))
        elif not line.strip():
            flush()
        else:
            held.append(line)
        k += 1
    flush()
    return blocks


def notebook_blocks_of(content: bytes) -> list[Block]:
    """Markdown cells as their blocks, code cells as code; outputs left out."""
    out: list[Block] = []
    for cell in json.loads(decode(content)).get("cells", []):
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        if cell.get("cell_type") == "markdown":
            out += markdown_blocks_of(source)
        elif source.strip():
            out.append(("code", 0, source))
    return out


# Office Open XML


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _value(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _text(e) -> str:
    """Text of runs, with tabs and breaks."""
    out = []
    for x in e.iter():
        name = _local(x)
        out.append(x.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out).strip()


def _word_table(e) -> str:
    cells = []
    rows = [x for x in e if _local(x) == "tr"]
    for r, row in enumerate(rows):
        column = 0
        for cell in (x for x in row if _local(x) == "tc"):
            span, merge = 1, None
            for x in cell.iter():
                if _local(x) == "gridSpan":
                    span = int(_value(x, "val") or 1)
                elif _local(x) == "vMerge":
                    merge = _value(x, "val") or "continue"
            text = " ".join(filter(None, (_text(p) for p in cell if _local(p) == "p")))
            if merge == "continue":  # grows the cell above
                for k, (top, own, down, right, at) in enumerate(cells):
                    if at == column and top + down == r:
                        cells[k] = (top, own, down + 1, right, at)
            else:
                cells.append((r, text, 1, span, column))
            column += span
    return render(finish(place([c[:4] for c in cells])))


def docx_blocks_of(content: bytes) -> list[Block]:
    """Paragraphs, headings by style or outline level, list items and tables, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        levels = {}
        if "word/styles.xml" in z.namelist():
            for style in (x for x in ElementTree.fromstring(z.read("word/styles.xml")).iter() if _local(x) == "style"):
                outline = next((x for x in style.iter() if _local(x) == "outlineLvl"), None)
                name = next((_value(x, "val") for x in style if _local(x) == "name"), "") or ""
                if outline is not None:
                    levels[_value(style, "styleId")] = int(_value(outline, "val")) + 1
                elif m := re.fullmatch(r"heading (\d)", name.lower()):
                    levels[_value(style, "styleId")] = int(m[1])
    out: list[Block] = []

    def walk(parent):
        for e in parent:
            name = _local(e)
            if name == "p":
                text = _text(e)
                style = next((_value(x, "val") for x in e.iter() if _local(x) == "pStyle"), None)
                outline = next((_value(x, "val") for x in e.iter() if _local(x) == "outlineLvl"), None)
                level = int(outline) + 1 if outline and outline.isdigit() and int(outline) < 9 else levels.get(style) or (int(m[1]) if style and (m := re.fullmatch(r"Heading(\d)", style)) else 0)
                number = next((x for x in e.iter() if _local(x) == "ilvl"), None)
                if text:
                    out.append(("heading", level, text) if level else ("item", int(_value(number, "val") or 0) + 1, text) if number is not None else ("para", 0, text))
            elif name == "tbl":
                if text := _word_table(e):
                    out.append(("table", 0, text))
            elif name in ("body", "sdt", "sdtContent", "ins"):
                walk(e)

    walk(body)
    return out


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx_blocks_of(content: bytes) -> list[Block]:
    """A slide's title as a heading, its other paragraphs, its tables."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"):
            for shape in ElementTree.fromstring(z.read(name)).iter():
                if _local(shape) == "sp":
                    kind = next((_value(x, "type") for x in shape.iter() if _local(x) == "ph"), None)
                    for p in (x for x in shape.iter() if _local(x) == "p"):
                        if text := _text(p):
                            out.append(("heading", 1, text) if kind in ("title", "ctrTitle") else ("para", 0, text))
                elif _local(shape) == "tbl":
                    cells = []
                    for r, row in enumerate(x for x in shape if _local(x) == "tr"):
                        for cell in (x for x in row if _local(x) == "tc"):
                            if _value(cell, "hMerge") != "1" and _value(cell, "vMerge") != "1":
                                cells.append((r, _text(cell), int(_value(cell, "rowSpan") or 1), int(_value(cell, "gridSpan") or 1)))
                    if text := render(finish(place(cells))):
                        out.append(("table", 0, text))
    return out


def xlsx_blocks_of(content: bytes) -> list[Block]:
    """A heading and a table for each sheet; shared and inline strings, numbers as they stand."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [_value(x, "name") or "" for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x) == "sheet"]
        for k, name in enumerate(_numbered(names, r"xl/worksheets/sheet(\d+)\.xml")):
            grid: list[list[str]] = []
            for row in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x) == "row"):
                line: list[str] = []
                for cell in (x for x in row if _local(x) == "c"):
                    letters = re.match("[A-Z]+", cell.get("r") or "")
                    at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else len(line)
                    value = next((x.text or "" for x in cell if _local(x) == "v"), "")
                    text = shared[int(value)] if cell.get("t") == "s" and value else _text(cell) if cell.get("t") == "inlineStr" else value
                    line += [""] * (at - len(line)) + [" ".join(text.split())]
                grid.append(line)
            if text := render(finish(grid)):
                out += [("heading", 1, titles[k] if k < len(titles) else name), ("table", 0, text)]
    return out


# HWPX: a ZIP of Korean word processor XML

# The shapes of paragraphs that make headings and list items, and elements that stand for a character.
HWPX_SHAPES = {"OUTLINE": "heading", "NUMBER": "item", "BULLET": "item"}
HWPX_CHARACTERS = {"tab": "\t", "lineBreak": "\n", "fwSpace": " ", "nbSpace": " ", "hyphen": " "}


def _number(e, name: str, other: int) -> int:
    value = _value(e, name) if e is not None else None
    return int(value) if value and value.isdigit() else other


def _first(e, name: str):
    return next((x for x in e if _local(x) == name), None)


def _inner(e):
    """Paragraphs of the outermost lists under an element."""
    for x in e:
        if _local(x) == "subList":
            yield from (p for p in x if _local(p) == "p")
        else:
            yield from _inner(x)


def _hwpx_table(table, shapes, notes) -> tuple[int, str]:
    """(header rows, rendered rows): cells by their addresses; text repeats down a merge, and of a wide cell its first column has it."""
    grid: dict[tuple[int, int], str] = {}
    plain: set[int] = set()
    for r, row in enumerate(x for x in table if _local(x) == "tr"):
        column = 0
        for cell in (x for x in row if _local(x) == "tc"):
            at, span = _first(cell, "cellAddr"), _first(cell, "cellSpan")
            top, left = _number(at, "rowAddr", r), _number(at, "colAddr", column)
            down, right = min(_number(span, "rowSpan", 1), 200), min(_number(span, "colSpan", 1), 60)
            column = left + right
            if _value(cell, "header") not in ("1", "true"):
                plain.add(top)
            # A table in the cell goes on as lines of words.
            lines = [t.replace("|", " ") if kind == "table" else t for p in _inner(cell) for kind, _, t in _hwpx_paragraph(p, shapes, notes)]
            for y in range(top, top + down):
                grid |= {(y, x): "\n".join(lines) if x == left else "" for x in range(left, left + right)}
    height, width = (max((k[i] for k in grid), default=-1) + 1 for i in (0, 1))
    named = {y for y, _ in grid}
    heads = next((y for y in range(height) if y in plain or y not in named), height)
    return heads, render(finish([[grid.get((y, x), "") for x in range(width)] for y in range(height)]))


def _hwpx_paragraph(p, shapes, notes):
    """Blocks of a paragraph, in order; the text of its footnotes and endnotes goes to notes."""
    kind, level = shapes.get(_value(p, "paraPrIDRef"), ("para", 0))
    held: list[str] = []

    def flush():
        text = "".join(held).strip()
        held.clear()
        return [(kind, level, text)] if text else []

    for part in (x for run in p if _local(run) == "run" for x in run):
        name = _local(part)
        if name == "t":
            held.append((part.text or "") + "".join(HWPX_CHARACTERS.get(_local(x), "") + (x.tail or "") for x in part))
        elif name == "tbl":
            yield from flush()
            heads, text = _hwpx_table(part, shapes, notes)
            if text:
                yield "table", heads, text
        elif name == "ctrl":
            for note in (x for x in part if _local(x) in ("footNote", "endNote")):
                text = "\n".join(t for q in _inner(note) for _, _, t in _hwpx_paragraph(q, shapes, notes))
                if text:
                    notes.append(text)
        elif name not in ("secPr", "colPr"):
            inner = list(_inner(part))
            if inner:
                yield from flush()
            for q in inner:
                yield from _hwpx_paragraph(q, shapes, notes)
    yield from flush()


def hwpx_blocks_of(content: bytes) -> list[Block]:
    """Paragraphs as headings or items by their shape, tables, text of frames in its place; notes at the end under a heading of their own.

    Running heads are left out, as is a section that is broken while others can be read.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sections = _numbered(z.namelist(), r"Contents/section(\d+)\.xml")
        shapes = {}
        if "Contents/header.xml" in z.namelist():
            for shape in (x for x in ElementTree.fromstring(z.read("Contents/header.xml")).iter() if _local(x) == "paraPr"):
                heading = _first(shape, "heading")
                if heading is not None and (kind := HWPX_SHAPES.get((_value(heading, "type") or "").upper())):
                    shapes[_value(shape, "id")] = (kind, _number(heading, "level", 0) + 1)
        roots, fault = [], ValueError("no section")
        for name in sections:
            try:
                roots.append(ElementTree.fromstring(z.read(name)))
            except ElementTree.ParseError as e:
                fault = e
    if not roots:
        raise fault
    notes: list[str] = []
    out = [b for root in roots for p in root if _local(p) == "p" for b in _hwpx_paragraph(p, shapes, notes)]
    return out + ([("heading", 1, "각주"), *(("note", 0, n) for n in notes)] if notes else [])


# Dispatch

PARSERS = {"hwpx": hwpx_blocks_of, "docx": docx_blocks_of, "pptx": pptx_blocks_of, "xlsx": xlsx_blocks_of, "html": html_blocks_of, "htm": html_blocks_of, "md": lambda c: markdown_blocks_of(decode(c)), "ipynb": notebook_blocks_of}


def text_blocks_of(content: bytes) -> list[Block]:
    return [("para", 0, x.strip()) for x in re.split(r"\n\s*\n", decode(content)) if x.strip()]


def blocks_of(path: str, content: bytes | None) -> tuple[list[Block], str]:
    """Blocks of a file by its extension, and why it fell back to plain text (empty if it did not)."""
    content = content or b""
    extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    found = detect(content, extension)
    if found in ("empty", "encrypted", "broken") or found.startswith("mismatch") and found != "mismatch:text":
        return [], found
    parser = PARSERS.get(extension)
    if parser is None:
        return (text_blocks_of(content), "") if found == "text" else ([], f"no parser: {found}")
    try:
        return parser(content), ""
    except Exception as e:  # noqa: BLE001 - whatever a broken file raises, its text is still worth having
        return (text_blocks_of(content), type(e).__name__) if found in ("text", "mismatch:text") else ([], type(e).__name__)


def parsed(files: DataFrame) -> DataFrame:
    """path, pos, kind, level, text, note of each block of files (path, content); a file without blocks is one row with pos null."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                blocks, note = blocks_of(path, content)
                rows += [(path, k, *b, note) for k, b in enumerate(blocks)] or [(path, None, None, None, None, note)]
            names = ["path", "pos", "kind", "level", "text", "note"]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, "path string, pos int, kind string, level int, text string, note string")


def dump_blocks(blocks: DataFrame, path: str) -> None:
    """The blocks as JSON lines."""
    blocks.write.json(path)


@frame(
    r"""WITH n AS (SELECT page_id, regexp_extract_all(html, '<(h[1-6])[ >]', 1) AS hs FROM pages)
SELECT page_id, len(hs)::BIGINT AS headings, len(list_filter(hs, lambda h: h = 'h1'))::BIGINT AS top FROM n"""
)
def html_blocks(spark, d):
    """Headings that the HTML parser finds on each page; the counts must be those of the tags."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{d}/pages.parquet")
    found = parsed(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content")))
    heads = found.where("kind = 'heading'").groupBy("path").agg(F.count(F.lit(1)).alias("headings"), F.count_if(F.col("level") == 1).alias("top"))
    ids = pages.select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"))
    return ids.join(heads, "path", "left").select("page_id", F.coalesce("headings", F.lit(0)).cast("long").alias("headings"), F.coalesce("top", F.lit(0)).cast("long").alias("top"))


@frame()
def md_blocks(spark, d):
    """Blocks of every document read as Markdown."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{d}/documents.parquet")
    return parsed(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content")))


@frame()
def detect_format(spark, d):
    """What each page and document is by its first bytes, under three extensions."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.substring("text", 1, 64).alias("head"))
    kind = F.udf(lambda head, ext: detect((head or "").encode(), ext), "string")
    return docs.select("doc_id", *(kind("head", F.lit(x)).alias(x) for x in ("txt", "pdf", "docx")))
