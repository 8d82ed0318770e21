"""Properties that files carry: title, author, dates, counts (inventory S24), for Office Open XML, HWPX and PDF."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import frame
from tessera.sources.parsing import MEMBERS, _first, _local, _numbered, _text, _value, detect, parsed

# Names of properties in each format, and ours.
CORE = {"title": "title", "creator": "author", "lastModifiedBy": "last_saved_by", "created": "created", "modified": "modified"}
APP = {"Template": "template", "Pages": "pages", "Slides": "slides", "Application": "app"}
HWPX_META = {"creator": "author", "lastsaveby": "last_saved_by", "CreatedDate": "created", "ModifiedDate": "modified"}
PDF_INFO = {b"Title": "title", b"Author": "author", b"Creator": "app", b"Producer": "producer", b"CreationDate": "created", b"ModDate": "modified"}
SCHEMA = "path string, format string, status string, properties map<string,string>, sheets array<string>, slide_titles array<string>"


def _named(data: bytes, names: dict[str, str]) -> dict[str, str]:
    texts = ((names.get(_local(x)), (x.text or "").strip()) for x in ElementTree.fromstring(data))
    return {name: text for name, text in texts if name and text}


def _slide_title(data: bytes) -> str:
    """Text of the first title shape; empty without one."""
    for shape in (x for x in ElementTree.fromstring(data).iter() if _local(x) == "sp"):
        if any(_local(x) == "ph" and _value(x, "type") in ("title", "ctrTitle") for x in shape.iter()):
            return " ".join(_text(shape).split())
    return ""


def _word_headings(z: zipfile.ZipFile) -> int:
    """Paragraphs whose style is named a heading or the title."""
    styles = set()
    for style in (x for x in ElementTree.fromstring(z.read("word/styles.xml")).iter() if _local(x) == "style"):
        name = _first(style, "name")
        if name is not None and re.match("heading|title$", (_value(name, "val") or "").lower()):
            styles.add(_value(style, "styleId"))
    return sum(_local(x) == "pStyle" and _value(x, "val") in styles for x in ElementTree.fromstring(z.read("word/document.xml")).iter())


def ooxml_properties(content: bytes) -> tuple[dict[str, str], list[str], list[str]]:
    """(properties, sheets, slide titles) of a document, workbook or presentation; parts that are missing give nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, found = set(z.namelist()), {}
        for member, known in (("docProps/core.xml", CORE), ("docProps/app.xml", APP)):
            if member in names:
                found |= _named(z.read(member), known)
        if {"word/document.xml", "word/styles.xml"} <= names:
            found["headings"] = str(_word_headings(z))
        sheets = [_value(x, "name") or "" for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x) == "sheet"] if "xl/workbook.xml" in names else []
        titles = [_slide_title(z.read(n)) for n in _numbered(list(names), r"ppt/slides/slide(\d+)\.xml")]
    return found | ({"slides": str(len(titles))} if titles else {}), sheets, titles


def hwpx_properties(content: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = {}
        for x in ElementTree.fromstring(z.read("Contents/content.hpf")).iter():
            name = "title" if _local(x) == "title" else HWPX_META.get(_value(x, "name") or "") if _local(x) == "meta" else None
            if name and (text := (x.text or "").strip()):
                found[name] = text
    return found


def _pdf_text(raw: bytes) -> str:
    """A literal or hexadecimal string: UTF-16 under its mark, else Latin-1."""
    if raw.startswith(b"<"):
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) % 256]) if m[1][:1] in b"01234567" else plain.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return data.decode("utf-16", "replace") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("latin-1")


def pdf_properties(content: bytes) -> dict[str, str]:
    """Of the last plain Info dictionary, and the number of page objects in the open. Compressed object streams are not read."""
    found = {}
    if refs := re.findall(rb"/Info\s+(\d+)\s+(\d+)\s+R", content):
        at = [m.end() for m in re.finditer(rb"(?<!\d)%s\s+%s\s+obj" % refs[-1], content)]
        body = content[at[-1] : content.find(b"endobj", at[-1])] if at else b""
        for key, raw in re.findall(rb"/(\w+)\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)", body, re.DOTALL):
            if key in PDF_INFO and (text := _pdf_text(raw).strip()):
                found[PDF_INFO[key]] = text
    pages = len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", content))
    return found | ({"pages": str(pages)} if pages else {})


def properties_of(path: str, content: bytes | None) -> tuple[str, str, dict[str, str], list[str], list[str]]:
    """(format, status, properties, sheets, slide titles); status is `ok`, or why there are none."""
    content = content or b""
    found = detect(content, path.rsplit(".", 1)[-1].lower() if "." in path else "").removeprefix("mismatch:")
    try:
        if found in {kind for _, kind in MEMBERS} - {"hwpx"}:
            return found, "ok", *ooxml_properties(content)
        if found in ("hwpx", "pdf"):
            return found, "ok", (hwpx_properties if found == "hwpx" else pdf_properties)(content), [], []
    except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, ValueError) as e:
        return found, f"failed: {type(e).__name__}", {}, [], []
    return found, found if found in ("empty", "broken", "encrypted") else "ok", {}, [], []


def properties(files: DataFrame) -> DataFrame:
    """path, format, status, properties, sheets, slide_titles of each file (path, content); nothing moves, a task holds a batch of files."""

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["path", "format", "status", "properties", "sheets", "slide_titles"]
        for batch in batches:
            rows = [(path, *properties_of(path or "", content)) for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            columns = [[list(r[k].items()) if k == 3 else r[k] for r in rows] for k in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def _as_hwpx(text: str, title: str | None, author: str | None) -> bytes:
    """A small HWPX file with a paragraph a line."""
    lines = "".join(f"<p><run><t>{escape(line)}</t></run></p>" for line in text.split("\n"))
    meta = f"<title>{escape(title or '')}</title><meta name='creator'>{escape(author or '')}</meta>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/content.hpf", f"<package>{meta}</package>")
        z.writestr("Contents/section0.xml", f"<sec>{lines}</sec>")
    return out.getvalue()


@frame(
    r"""WITH t AS (SELECT doc_id, nullif(trim(lang), '') AS title, nullif(trim(source), '') AS author, unnest(string_split(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x1F\x7F-\x9F]', ' ', 'g'), chr(10))) AS line FROM documents),
b AS (SELECT doc_id, title, author, regexp_replace(line, '[\s\p{Z}]+', '', 'g') AS line FROM t)
SELECT doc_id, title, author, count(*) FILTER (line <> '')::BIGINT AS n_blocks, sum(length(line))::BIGINT AS n_letters FROM b GROUP BY ALL"""
)
def hwpx_files(spark, d):
    """Each document written as an HWPX file and read back: properties, paragraphs with text, and letters that are no white space."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x09\x0B-\x1F\x7F-\x9F]", " ")
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".hwpx")).alias("path"), F.udf(_as_hwpx, "binary")(plain, "lang", "source").alias("content"))
    of_file = F.regexp_replace("path", "[.]hwpx$", "").cast("long")
    letters = F.length(F.regexp_replace("text", r"[\s\p{Z}]+", ""))
    blocks = parsed(files).groupBy(of_file.alias("doc_id")).agg(F.count("pos").alias("n_blocks"), F.coalesce(F.sum(letters), F.lit(0)).alias("n_letters"))
    held = properties(files).select(of_file.alias("doc_id"), F.col("properties")["title"].alias("title"), F.col("properties")["author"].alias("author"))
    return held.join(blocks, "doc_id")
