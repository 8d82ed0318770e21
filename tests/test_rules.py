"""Row functions on literal cases: parsers, tables, answers, phrases."""

import datetime as dt
import io
import json
import zipfile

import pytest

from tessera import registry
from tessera.functions import answers, phrases, tables
from tessera.sources import parsing

TODAY = dt.date(2026, 10, 29)


def day(*x):
    return dt.date(*x)


@pytest.mark.parametrize(
    "q, first, end",
    [
        ("작년 3월쯤 보고서", day(2025, 2, 1), day(2025, 5, 1)),
        ("report from last year, around March", day(2025, 2, 1), day(2025, 5, 1)),
        ("12월 자료", day(2025, 12, 1), day(2026, 1, 1)),
        ("지난주 메일", day(2026, 10, 22), day(2026, 10, 30)),
        ("재작년", day(2024, 1, 1), day(2025, 1, 1)),
        ("24년 상반기", day(2024, 1, 1), day(2024, 7, 1)),
        ("2023년도", day(2023, 1, 1), day(2024, 1, 1)),
        ("3년 전 문서", day(2023, 1, 1), day(2024, 1, 1)),
        ("2개월 전", day(2026, 8, 1), day(2026, 9, 1)),
        ("이번 달", day(2026, 10, 1), day(2026, 11, 1)),
        ("지난달", day(2026, 9, 1), day(2026, 10, 1)),
        ("최근", day(2026, 7, 31), day(2026, 10, 30)),
    ],
)
def test_time(q, first, end):
    assert phrases.parse_time(q, TODAY)[:2] == (first, end)


def test_no_time():
    assert phrases.parse_time("계약서 찾아줘", TODAY) is None
    assert phrases.seconds(day(2026, 1, 1)) == 1767193200  # midnight in Seoul


def test_query_parts():
    got = phrases.parse_query("작년 Minsu 만든 pdf 스캔 계약서 내가", {"Kim Minsu": "Kim Minsu", "Minsu": "Kim Minsu", "Lee": "Lee Jiwon"}, "Park", TODAY)
    assert (got["people"], got["role"], got["formats"], got["scanned"], got["rest"]) == (["Kim Minsu", "Park"], "author", ["pdf"], True, "계약서")
    assert phrases.parse_query("Leeds plan", {"Lee": "Lee Jiwon"}, None, TODAY)["people"] == []


def test_html():
    page = """<html><head><title>t</title><style>x{}</style></head><body><nav><a>menu</a></nav><header>top</header><h1>One &amp; two</h1>
<div>para <b>bold</b></div><ul><li>first<ul><li>inner</li></ul></li><li>second</li></ul><script>var x = '<p>no</p>';</script>
<table><tr><th>Name</th><th colspan=2>Marks</th></tr><tr><td rowspan=2>Ann</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table><h2>End</h2><footer>f</footer></body></html>"""
    assert parsing.html_blocks_of(page.encode()) == [
        ("heading", 1, "One & two"),
        ("para", 0, "para bold"),
        ("item", 1, "first"),
        ("item", 2, "inner"),
        ("item", 1, "second"),
        ("table", 0, "| Name | Marks |  |\n| Ann | 1 | 2 |\n| Ann | 3 | 4 |"),
        ("heading", 2, "End"),
    ]


def test_markdown_and_notebook():
    text = "# Top #\nline one\nline two\n\n- a\n  - b\n1. c\n\n```py\n# no heading\n```\n| h1 | h2 |\n|---|:-:|\n| x | y |\nafter"
    want = [("heading", 1, "Top"), ("para", 0, "line one line two"), ("item", 1, "a"), ("item", 2, "b"), ("item", 1, "c"), ("code", 0, "# no heading"), ("table", 1, "| h1 | h2 |\n| x | y |"), ("para", 0, "after")]
    assert parsing.markdown_blocks_of(text) == want
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "a = 1", "outputs": ["no"]}, {"cell_type": "code", "source": " "}]})
    assert parsing.notebook_blocks_of(book.encode()) == [("heading", 1, "T"), ("para", 0, "x"), ("code", 0, "a = 1")]


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


W = 'xmlns:w="http://w"'
DOCX = packed(
    word__document_xml=f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>deep</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
)


def test_office_files():
    assert parsing.docx_blocks_of(DOCX) == [("heading", 2, "Title"), ("para", 0, "a\tb"), ("item", 2, "deep"), ("table", 0, "| v | wide |  |\n| v | 1 | 2 |")]
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:txBody><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>text</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    assert parsing.pptx_blocks_of(packed(ppt__presentation_xml="<p/>", ppt__slides__slide2_xml=slide.replace("Slide", "Two"), ppt__slides__slide1_xml=slide)) == [("heading", 1, "Slide"), ("para", 0, "text"), ("heading", 1, "Two"), ("para", 0, "text")]
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>in</t></is></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>'
    book = packed(xl__workbook_xml='<workbook><sheets><sheet name="Data"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>shared</t></si></sst>", xl__worksheets__sheet1_xml=sheet)
    assert parsing.xlsx_blocks_of(book) == [("heading", 1, "Data"), ("table", 0, "| shared | 5 |\n| in | 7 |")]


def test_detect_and_dispatch(spark):
    assert parsing.detect(b"", "pdf") == "empty"
    assert parsing.detect(b"%PDF-1.7", "pdf") == "pdf" and parsing.detect(b"plain", "pdf") == "mismatch:text"
    assert parsing.detect(DOCX, "docx") == "docx" and parsing.detect(DOCX, "xlsx") == "mismatch:docx"
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    assert parsing.detect(ole, "doc") == "doc" and parsing.detect(ole + "EncryptedPackage".encode("utf-16-le"), "docx") == "encrypted"
    assert parsing.decode("가나".encode("cp949")) == "가나" and parsing.decode(b"\xef\xbb\xbfx") == "x" and parsing.decode(b"\xff\xfe\xfd") == "���"
    rows = [("a.docx", DOCX), ("b.txt", b"one\n\ntwo"), ("c.ipynb", b"no json"), ("d.pdf", None), ("e.docx", b"PK\x03\x04broken"), ("f.md", b"# h")]
    got = parsing.parsed(spark.createDataFrame(rows, "path string, content binary")).collect()
    by = {p: [(r["kind"], r["text"], r["note"]) for r in got if r["path"] == p] for p, _ in rows}
    assert len(by["a.docx"]) == 4 and by["b.txt"] == [("para", "one", ""), ("para", "two", "")]
    assert by["c.ipynb"] == [("para", "no json", "JSONDecodeError")] and by["d.pdf"] == [(None, None, "empty")] and by["e.docx"][0][2] == "broken" and by["f.md"] == [("heading", "h", "")]


def test_tables():
    assert tables.place([(0, "a", 2, 1), (0, "b", 1, 2), (1, "c", 1, 1), (1, "d", 1, 1)]) == [["a", "b", ""], ["a", "c", "d"]]
    assert tables.finish([["x", "", "y"], ["", "", ""], ["z"]]) == [["x", "y"], ["z", ""]]
    assert tables.is_header(["Name", "Age"]) and not tables.is_header(["Name", "12"]) and not tables.is_header(["Name", ""])
    assert tables.flatten("t\n| Name | Age |\n| Ann | 5 |\n| Bob |  |\nend") == "t\nName: Ann / Age: 5\nName: Bob\nend"
    assert tables.flatten("| 1 | 2 |\n| 3 | 4 |") == "| 1 | 2 |\n| 3 | 4 |"
    assert tables.flatten("| A | B | C |\n| x | y |").split("\n")[-1] == "B: x / C: y"
    assert tables.rebuild("h\na\tb\nc\td\nx") == "h\n| a | b |\n| c | d |\nx" and tables.rebuild("one\tline") == "one\tline"
    assert tables.rebuild("1\v2\v3\ta\vb\vc\nd\te") == "| 1 | a |\n| 2 | b |\n| 3 | c |\n| d | e |"
    assert tables.tidy([["one"], ["two"]]) == (["one", "two"], [])
    assert tables.toc_lines(["Intro ..... 1", "Body\t12", "End   20", "text", "x ... 3"]) == [True, True, True, False, False]


def test_answers():
    evidence = ["sales were 1,200 in 2020", "the cost was 35"]
    assert answers.recite("Sales were 1200 [2]. Cost 35 [2].", evidence) == "Sales were 1200 [1]. Cost 35 [2]."
    assert answers.recite("Nothing 99 [1].", evidence) == "Nothing 99 [1]."
    assert answers.clean_answer("Answer in short:\n**bold** text [1] [1][1]\n\n\n\nend", ("Answer in short",)) == "bold text [1]\n\nend"
    assert answers.line_ok("The sales were 1200 in 2020.", evidence) and not answers.line_ok("The sales were 1300 in 2020.", evidence) and not answers.line_ok("short 35", evidence)
    cut = answers.fit_prompt(["x" * 1000, "y" * 50], 10, 300)
    assert 10 + sum(map(len, cut)) <= 300 and cut[1] == "y" * 50
    assert answers.fit_prompt(["x" * 100, "y" * 45], 0, 10) == ["x" * 40, "y" * 45]  # a fifth less of 45 would be under 40
    tokens = list("abcdefgh") + list("wxyz") * 3
    assert answers.loop_start(tokens) == 12 and answers.guard(tokens + list("tail"), 100) == (tokens[:12], "loop")
    assert answers.loop_start(list("abcabc")) == 6 and answers.guard(list("abcdef"), 3) == (list("abc"), "cap")
    text = "filler " * 30 + "the contract of sale and the price" + " more" * 40
    shown, marks = answers.snippet(text, ["contract", "price", "absent"])
    assert shown.startswith("…") and shown.endswith("…") and [shown[a:b] for a, b in marks] == ["contract", "price"]
    assert answers.snippet("a refund is due", ["refinance"])[1] == [(2, 4)]
    rules = {"labour contract": ["work paper", "work"], "wage": ["pay", "salary"]}
    assert answers.expand("my work paper and pay", rules) == "my work paper and pay labour contract wage"
    assert answers.expand("wage and pay", rules) == "wage and pay" and answers.expand("repay", rules) == "repay"
    assert answers.expand("my pay", rules, {("pay", "wage")}) == "my pay"


def test_long_texts_are_read_whole(spark, tmp_path):
    turn = [f"w{k}" for k in range(700)]
    texts = [(1, " ".join([*(f"a{k}" for k in range(14)), *turn * 4])), (2, " ".join(turn * 2)), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["kept"] for r in registry.queries()["loop_guard"](spark, str(tmp_path)).collect()}
    assert got == {1: 714, 2: 1400, 3: 0}


def test_snippets_fold_and_end_with_the_text():
    text = "start " * 40 + "the price\n\tis  here"
    shown, marks = answers.snippet(text, ["price", "here"])
    assert shown == "…" + " ".join(text.split())[-answers.WINDOW :] and [shown[a:b] for a, b in marks] == ["price", "here"]
    assert answers.snippet("a  b\nc", ["b"]) == ("a b c", [(2, 3)])


def test_wide_cells_keep_their_width():
    grid = tables.place([(0, "w", 1, 80), (0, "next", 1, 1), (1, "down", 999, 1)])
    assert grid[0][80] == "next" and len(grid) == 2 and grid[1][0] == "down"
