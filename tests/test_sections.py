"""Sections of texts and blocks against plain folds, and literal rows."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import sections

ARTICLES = "앞글\n제1조 (목적)\n가\n제 2 조(정의)\n나\n제3조 효력\n다\n별표 1 수수료\n라"
CASES = {
    ARTICLES: ("article", [(None, "앞글"), ("제1조 (목적)", "가\n"), ("제 2 조(정의)", "나\n"), ("제3조 효력", "다\n"), ("별표 1 수수료", "라")]),
    "# One\na\n## Two\n\n### Three": ("markdown", [("One", "a\n"), ("Two", "\n"), ("Three", "")]),
    "1. A\nx\n1.1 B\n2 C\ny": ("numbered", [("1. A", "x\n"), ("1.1 B", ""), ("2 C", "y")]),
    "# One\n# Two\ntext": ("none", [(None, "# One\n# Two\ntext")]),
    "머리\n별표 1\n가\n부칙\n나": ("none", [(None, "머리"), ("별표 1", "가\n"), ("부칙", "나")]),
    "별표 1\n가": ("none", [(None, "별표 1\n가")]),
    "별표 1\n가\n별표가 있다\n부칙은 없다": ("none", [(None, "별표 1\n가\n별표가 있다\n부칙은 없다")]),
    "2.1 " + "long " * 12 + "\nx\n3 B\n4 C": ("numbered", [("2.1", "2.1 " + "long " * 12 + "\nx\n"), ("3 B", ""), ("4 C", "")]),
    "": ("none", [(None, "")]),
    None: ("none", [(None, "")]),
}


def test_texts_are_split_by_grammar(spark):
    docs = spark.createDataFrame([(k, x, k) for k, x in enumerate(CASES)] + [(None, ARTICLES, 0), (None, "", 1)], "doc_id long, text string, section long")
    got = {}
    for r in sections.split_texts(docs, ["doc_id"]).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["grammar"], r["label"], r["body"]))
    for k, (grammar, want) in enumerate(CASES.values()):
        assert sorted(got[k]) == [(n, grammar, *own) for n, own in enumerate(want)], k
    assert len(got[None]) == 6
    assert sections.split_texts(docs.where("false"), ["doc_id"]).collect() == []


def folded(blocks):
    """Sections of one document's blocks by a stack."""
    out, stack, own = [], [], {"path": [], "heading": None, "n": 0, "pages": []}
    put = lambda: out.append(own) if own["heading"] is not None or own["n"] else None
    for kind, level, text, page, synthetic in blocks:
        if kind in ("header", "footer", "page_number", "toc"):
            continue
        pages = [page] if page is not None else []
        if kind != "heading":
            own["n"] += 1
            own["pages"] += pages
            continue
        put()
        while stack and stack[-1][0] >= max(1, level or 1):
            stack.pop()
        flat = " ".join(text.split())
        short = flat.lstrip("#").strip() if len(flat) <= 40 else (m[0].strip() if (m := re.match(r"제\s*\d+\s*조|#{1,6}|[\dA-Z]+(?:\.\d+)*\.?", flat)) else flat[:40].rstrip() + "…")
        stack.append((max(1, level or 1), text.strip() if synthetic else short))
        own = {"path": [x for _, x in stack if x], "heading": text, "n": 0, "pages": pages}
    put()
    return [(k, s["path"], s["heading"], s["n"], min(s["pages"], default=None), max(s["pages"], default=None)) for k, s in enumerate(out)]


def test_paths_are_those_of_a_stack(spark):
    rng, rows, by = random.Random(3), [], {}
    texts = ["A", "## B", "", "  ", "3.2 " + "w " * 30, "제 7 조 " + "가 " * 30, "x" * 50, "Two  words"]
    for doc in range(60):
        own = [(rng.choice(["heading", "paragraph", "paragraph", "toc", "header"]), rng.choice([None, 0, 1, 1, 2, 3, 9, 15]), rng.choice(texts), rng.choice([None, 1, 2, 7]), rng.random() < 0.2) for _ in range(rng.choice([0, 1, 5, 40]))]
        by[doc] = folded(own)
        rows += [(doc if doc else None, "f", k, *x) for k, x in enumerate(own)]
    blocks = spark.createDataFrame(rows, "doc_id long, file string, pos long, type string, level int, text string, page int, synthetic boolean").repartition(5)
    got = {}
    for r in sections.build_sections(blocks, ["doc_id", "file"]).collect():
        got.setdefault(r["doc_id"] or 0, []).append((r["section"], r["path"], r["heading"], r["n_blocks"], r["page_from"], r["page_to"]))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: v for k, v in by.items() if v}
    assert sections.build_sections(blocks.where("false"), ["doc_id", "file"]).collect() == []


def test_stacks_merge():
    """The stack after two runs of headings is what lies below the second's least level, then the second's stack."""
    rng = random.Random(5)

    def stack(levels):
        out = []
        for k in levels:
            out = [x for x in out if x < k] + [k]
        return out

    for _ in range(300):
        a, b = ([rng.randint(1, 6) for _ in range(rng.randint(0, 8))] for _ in range(2))
        second = stack(b)
        assert stack(a + b) == [x for x in stack(a) if not second or x < second[0]] + second


def test_paths_of_repeated_rows(spark):
    rows = [(1, k, lv, f"h{k}") for k, lv in enumerate([1, 2, 2, 1, 3])] * 2
    got = sections.with_paths(spark.createDataFrame(rows, "d long, at long, level int, label string"), ["d"], "at", "level", "label").collect()
    want = {0: ["h0"], 1: ["h0", "h1"], 2: ["h0", "h2"], 3: ["h3"], 4: ["h3", "h4"]}
    assert len(got) == 10 and all(r["path"] == want[r["at"]] for r in got)


def test_paths_take_one_exchange(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("d"), F.col("id").alias("at"), (F.col("id") % 3).cast("int").alias("level"), F.lit("x").alias("label"))
    plan = sections.with_paths(rows, ["d"], "at", "level", "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_headers_of_table_rows(spark):
    text = "| a | b |\n| 1 | 2 |\nx\n| 3 | 4 |\n| c | d |\n\n| only |\n| e | f |\n\n| g | h |\n| 5 | i |"
    got = {r["pos"]: r["header"] for r in sections.table_rows(spark.createDataFrame([(1, text), (1, text), (2, None), (None, "| 1 | 2 |\n| x | y |")], "doc_id long, text string"), ["doc_id"]).collect()}
    one = "| a | b |"
    assert got == {1: one, 3: one, 4: one, 6: one, 7: one, 10: "| g | h |"}
