"""HWPX blocks and file properties on literal files."""

import io
import zipfile

import pytest

from tessera.sources import parsing, properties

NS = 'xmlns:hp="http://p" xmlns:hh="http://h" xmlns:opf="http://o" xmlns:w="http://w" xmlns:p="http://x" xmlns:a="http://a"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def par(*runs, shape="0"):
    return f'<hp:p paraPrIDRef="{shape}"><hp:run>{"".join(runs)}</hp:run></hp:p>'


def cell(row, col, text, down=1, right=1, header=0):
    return f'<hp:tc header="{header}"><hp:subList>{par(f"<hp:t>{text}</hp:t>")}</hp:subList><hp:cellAddr rowAddr="{row}" colAddr="{col}"/><hp:cellSpan rowSpan="{down}" colSpan="{right}"/></hp:tc>'


HEADER = f'<hh:head {NS}><hh:paraPr id="1"><hh:heading type="OUTLINE" level="1"/></hh:paraPr><hh:paraPr id="2"><hh:heading type="BULLET" level="0"/></hh:paraPr><hh:paraPr id="3"/></hh:head>'
NOTE = f"<hp:ctrl><hp:footNote><hp:subList>{par('<hp:t>a note</hp:t>')}</hp:subList></hp:footNote></hp:ctrl>"
HEAD = f"<hp:ctrl><hp:header><hp:subList>{par('<hp:t>running head</hp:t>')}</hp:subList></hp:header></hp:ctrl>"
FRAME = f"<hp:rect><hp:drawText><hp:subList>{par('<hp:t>in a frame</hp:t>')}</hp:subList></hp:drawText></hp:rect>"
TABLE = f"<hp:tbl><hp:tr>{cell(0, 0, 'name', header=1)}{cell(0, 1, 'wide', right=2, header=1)}</hp:tr><hp:tr>{cell(1, 0, 'down', down=2)}{cell(1, 1, '1')}{cell(1, 2, '2')}</hp:tr><hp:tr>{cell(2, 2, '4')}</hp:tr></hp:tbl>"
TEN = f"<hp:sec {NS}>{par('<hp:t>last</hp:t>')}</hp:sec>"
TWO = f"<hp:sec {NS}>{par('<hp:t>제목</hp:t>', shape='1')}{par('<hp:t>it</hp:t>', '<hp:t>em<hp:tab/>x<hp:lineBreak/>y</hp:t>', shape='2')}{par('<hp:t>before</hp:t>', FRAME, NOTE, HEAD, TABLE, '<hp:t>after</hp:t>', shape='3')}{par()}</hp:sec>"
HPF = f'<opf:package {NS}><opf:title> T </opf:title><opf:meta name="creator">A</opf:meta><opf:meta name="subject">S</opf:meta><opf:meta name="CreatedDate">2024</opf:meta></opf:package>'
BOOK = packed(**{"Contents/content.hpf": HPF, "Contents/header.xml": HEADER, "Contents/section10.xml": TEN, "Contents/section2.xml": TWO, "Contents/section3.xml": "<broken"})


def test_hwpx_blocks():
    assert parsing.hwpx_blocks_of(BOOK) == [
        ("heading", 2, "제목"), ("item", 1, "item\tx\ny"), ("para", 0, "before"), ("para", 0, "in a frame"),
        ("table", 1, "| name | wide |  |\n| down | 1 | 2 |\n| down |  | 4 |"), ("para", 0, "after"), ("para", 0, "last"), ("heading", 1, "각주"), ("note", 0, "a note"),
    ]
    assert parsing.blocks_of("x.hwpx", BOOK)[1] == "" and parsing.blocks_of("x.hwpx", packed(**{"Contents/content.hpf": HPF})) == ([], "ValueError")
    with pytest.raises(parsing.ElementTree.ParseError):
        parsing.hwpx_blocks_of(packed(**{"Contents/section0.xml": "<"}))


CORE = '<c xmlns:d="http://d"><d:title>Plan</d:title><d:creator>Kim</d:creator><d:lastModifiedBy> </d:lastModifiedBy><d:subject>no</d:subject></c>'
WORD = {"docProps/core.xml": CORE, "docProps/app.xml": "<a><Pages>7</Pages><Company>no</Company></a>"}
STYLES = f'<w:styles {NS}><w:style w:styleId="1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="2"><w:name w:val="Normal"/></w:style></w:styles>'
BODY = f'<w:document {NS}><w:pStyle w:val="1"/><w:pStyle w:val="2"/><w:pStyle w:val="1"/></w:document>'
SLIDE = f'<p:sld {NS}><p:sp><a:t>body</a:t></p:sp><p:sp><p:ph type="title"/><a:t>First</a:t><a:t> one</a:t></p:sp></p:sld>'
PDF = rb"%PDF-1.4 1 0 obj << /Type /Pages >> endobj 2 0 obj << /Type /Page >> endobj 3 0 obj <</Title (old)>> endobj 3 0 obj << /Title (a \(b\) \101) /Author <FEFFAC00> /Keywords (no) >> endobj trailer << /Info 3 0 R >>"


def test_properties(spark):
    docx = packed(**WORD, **{"word/document.xml": BODY, "word/styles.xml": STYLES})
    pptx = packed(**{"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": f"<p:sld {NS}/>", "ppt/slides/slide1.xml": SLIDE})
    xlsx = packed(**{"xl/workbook.xml": '<w><sheet name="One"/><sheet name="Two"/></w>'})
    rows = [("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.hwpx", BOOK), ("e.pdf", PDF), ("f.docx", None), ("g.docx", packed(**{"word/document.xml": "<", "docProps/core.xml": "<"})), ("h.txt", b"text"), ("i.xlsx", docx), (None, b"x")]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: tuple(r)[1:] for r in properties.properties(files).collect()}
    assert got["a.docx"] == got["i.xlsx"] == ("docx", "ok", {"title": "Plan", "author": "Kim", "pages": "7", "headings": "2"}, [], [])
    assert got["b.pptx"] == ("pptx", "ok", {"slides": "2"}, [], ["First one", ""]) and got["c.xlsx"] == ("xlsx", "ok", {}, ["One", "Two"], [])
    assert got["d.hwpx"] == ("hwpx", "ok", {"title": "T", "author": "A", "created": "2024"}, [], [])
    assert got["e.pdf"] == ("pdf", "ok", {"title": "a (b) A", "author": "가", "pages": "1"}, [], [])
    assert got["f.docx"] == ("empty", "empty", {}, [], []) and got["g.docx"][1] == "failed: ParseError" and got["h.txt"] == got[None] == ("text", "ok", {}, [], [])
