"""Sections of texts and of blocks (inventory C1-C5), in built-in functions alone.

A text is split in its own row: nothing is exchanged for grammars, sections and labels. Paths of headings are what a stack of levels holds: a heading of level v takes all of level v or
more off it. Two such stacks merge into one (what lies below the second's least level, then the second), so the stack after a heading is, of each level, the last heading that no lesser
level follows. That is a running maximum for each level, and all of them share one window over headings; bodies of sections do not pass through it.

White space is ASCII's. A null text is an empty one, and an empty one has one section. Rows equal in key and text give their sections once where a path is asked for, and as often as
they stand elsewhere; a null key is a key, told apart by the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import frame

# Forms of headings, tried in this order; a text has a grammar if three of its lines are headings of it.
GRAMMARS = {
    "article": r"^[ \t]*제\s*\d+\s*조\s*[(【][^\n]{0,60}?[)】][ \t]*\z|^[ \t]*제\s*\d+\s*조[ \t][^\n]{0,60}\z",
    "markdown": r"^[ \t]*#{1,6}[ \t]+\S[^\n]*\z",
    "numbered": r"^[ \t]*\d+(?:\.\d+)*\.?[ \t]+\S[^\n]{0,80}\z",
}
HEADINGS_NEEDED = 3
# Names of appendices; two of them make sections without a grammar, one does where there is a grammar.
APPENDIX = r"^[ \t]*[\[(]?\s*(?:별\s*표|별\s*첨|붙\s*임|참\s*고|서\s*식|부\s*록|첨\s*부)\s*#?\s*[\dA-Z](?:[^가-힣][^\n]*)?\z|^[ \t]*부\s*칙(?:[^가-힣][^\n]*)?\z"
APPENDICES_NEEDED = 2
# The longest line that is a title, the numbering of a longer one, and what a cell of numbers is.
TITLE = 40
NUMBERING = r"^(제\s*\d+\s*조|#{1,6}|[\dA-Z]+(?:\.\d+)*\.?)"
NUMBERS = r"^[-\d,.\s]+\z"
# Kinds of blocks that belong to no section.
EXCLUDED = ("header", "footer", "page_number", "toc")
#: Levels of headings; a deeper one counts as the last.
LEVELS = 16
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def grammar_of(lines: Column) -> Column:
    """The first grammar with enough headings, or `none`."""
    of = lambda form: F.size(F.filter(lines, lambda x: x.rlike(form)))
    return F.coalesce(*(F.when(of(form) >= HEADINGS_NEEDED, name) for name, form in GRAMMARS.items()), F.lit("none"))


def is_heading(line: Column, grammar: Column) -> Column:
    """Of the text's grammar; appendices are told by APPENDIX."""
    return F.coalesce(*(F.when(grammar == name, line.rlike(p)) for name, p in GRAMMARS.items()), F.lit(False))


def level_of(line: Column, grammar: Column) -> Column:
    """Signs of a markdown heading, numbers of a numbered one, else 1."""
    signs = F.length(F.regexp_extract(line, r"^[ \t]*(#{1,6})", 1))
    numbers = F.size(F.split(F.regexp_extract(line, r"^[ \t]*(\d+(?:\.\d+)*)", 1), r"\."))
    return F.when(line.rlike(APPENDIX), 1).when(grammar == "markdown", signs).when(grammar == "numbered", numbers).otherwise(1)


def _flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "), F.lit(" "))


def short_label(head: Column) -> Column:
    """The label of a section's first line: all of a title without its signs, of a longer line its numbering. Null if nothing is left."""
    flat = _flat(head)
    title = F.btrim(F.ltrim(flat, F.lit("#")), F.lit(" "))
    found = F.btrim(F.regexp_extract(flat, NUMBERING, 1), F.lit(" "))
    return F.nullif(F.when(F.length(flat) <= TITLE, title).otherwise(found), F.lit(""))


def block_label(head: Column) -> Column:
    """As short_label, but of a long line without numbering the beginning."""
    flat = _flat(head)
    return F.coalesce(short_label(head), F.when(F.length(flat) > TITLE, F.concat(F.rtrim(F.substring(flat, 1, TITLE)), F.lit("…"))))


def split_texts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, grammar, section (from 0), head, label, level, body: the sections of each text.

    What stands before the first heading is a section without label, without white space at its ends, if it has more than that. A title is not part of the body, a longer heading is.
    """
    cols = [F.col(f"`{k}`") for k in keys]
    lined = docs.select(*cols, lines_of(F.col(text)).alias("lines_")).withColumn("grammar_", grammar_of(F.col("lines_")))
    app = F.transform("lines_", lambda x: x.rlike(APPENDIX))
    lined = lined.withColumn("apps_", app).withColumn("split_", (F.col("grammar_") != "none") | (F.size(F.filter("apps_", lambda x: x)) >= APPENDICES_NEEDED))
    starts = F.filter(
        F.transform("lines_", lambda x, i: F.when(F.col("split_") & (F.element_at("apps_", i + 1) | is_heading(x, F.col("grammar_"))), i)),
        lambda x: x.isNotNull(),
    )
    lined = lined.withColumn("starts_", starts)
    bare = F.btrim(F.array_join(F.slice("lines_", 1, F.coalesce(F.get("starts_", F.lit(0)), F.size("lines_"))), "\n"), F.lit(BLANKS))
    whole = F.size("starts_") == 0
    first = F.when(whole | (F.length(bare) > 0), F.array(F.struct(F.lit(None).cast("string").alias("head"), F.when(whole, F.array_join("lines_", "\n")).otherwise(bare).alias("body"))))
    end = lambda i: F.coalesce(F.get("starts_", i + 1), F.size("lines_"))
    # A section reaches up to the next heading, line feed included.
    below = lambda s, i: F.when(end(i) - s > 1, F.concat(F.array_join(F.slice("lines_", s + 2, end(i) - s - 1), "\n"), F.when(end(i) < F.size("lines_"), "\n").otherwise(""))).otherwise("")
    rest = F.transform("starts_", lambda s, i: F.struct(F.element_at("lines_", s + 1).alias("head"), below(s, i).alias("body")))
    every = F.concat(F.coalesce(first, F.array().cast("array<struct<head:string,body:string>>")), rest)
    out = lined.select(*cols, F.col("grammar_").alias("grammar"), F.posexplode(every).alias("section", "own_"))
    long = F.length(_flat(F.col("own_.head"))) > TITLE
    body = F.when(long, F.concat("own_.head", F.lit("\n"), "own_.body")).otherwise(F.col("own_.body"))
    head = F.col("own_.head")
    return out.select(*cols, "grammar", F.col("section").cast("long").alias("section"), head.alias("head"), short_label(head).alias("label"), F.when(head.isNotNull(), level_of(head, F.col("grammar"))).alias("level"), body.alias("body"))


def with_paths(headings: DataFrame, keys: list[str], order: str, level: str, label: str) -> DataFrame:
    """headings and `path`: the labels on the stack at each row, its own last. Rows without a level are before the first heading and have no path.

    Rows of equal keys and order must be equal, and then agree. One window, sorted by order within keys; state is a row of LEVELS labels.
    """
    turn = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.least(F.greatest(F.col(level), F.lit(1)), F.lit(LEVELS))
    last = [F.max(F.when(held == k, F.struct(F.col(order).alias("at"), F.col(label).alias("label")))).over(turn).alias(f"last_{k}") for k in range(1, LEVELS + 1)]
    seen = headings.select("*", *last)
    steps, above = [], F.lit(-1).cast("long")
    for k in range(1, LEVELS + 1):
        at = F.coalesce(F.col(f"last_{k}.at").cast("long"), F.lit(-1))
        steps.append(F.when(at > above, F.col(f"last_{k}.label")))
        above = F.greatest(above, at)
    return seen.withColumn("path", F.filter(F.array(*steps), lambda x: x.isNotNull())).drop(*(f"last_{k}" for k in range(1, LEVELS + 1)))


def build_sections(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section (from 0), path, heading, n_blocks, page_from, page_to from blocks (keys, pos, type, level, text, page, synthetic).

    Blocks of EXCLUDED kinds count nowhere. A `heading` begins a section, what stands before the first is one if there is any; a synthetic heading's label is its text. pos is unique
    within keys. Blocks are exchanged once, by keys.
    """
    of = [F.col(f"`{k}`") for k in keys]
    turn = Window.partitionBy(*of).orderBy("pos")
    is_head = F.col("type") == "heading"
    kept = blocks.where(F.col("type").isNull() | ~F.col("type").isin(*EXCLUDED))
    kept = kept.withColumn("part_", F.sum(F.when(is_head, 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.when(F.coalesce(F.col("synthetic"), F.lit(False)), F.btrim(F.col("text"), F.lit(BLANKS))).otherwise(block_label(F.col("text")))
    head = F.max(F.when(is_head, F.struct(F.greatest(F.coalesce(F.col("level"), F.lit(1)), F.lit(1)).alias("level"), F.nullif(label, F.lit("")).alias("label"), F.col("text").alias("text"))))
    sections = kept.groupBy(*of, "part_").agg(head.alias("head_"), F.sum(F.when(is_head, 0).otherwise(1)).alias("n_blocks"), F.min("page").alias("page_from"), F.max("page").alias("page_to"))
    sections = sections.select(*of, "part_", F.col("head_.level").alias("level_"), F.col("head_.label").alias("label_"), F.col("head_.text").alias("heading"), "n_blocks", "page_from", "page_to")
    placed = with_paths(sections, keys, "part_", "level_", "label_")
    number = F.row_number().over(Window.partitionBy(*of).orderBy("part_")) - 1
    return placed.select(*of, number.cast("long").alias("section"), "path", "heading", "n_blocks", "page_from", "page_to")


def table_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, header: of each row of a table below a header, that header.

    The first row of a run of rows heads those after it if it has two cells or more and none of numbers alone; a run whose first row is none is headed by the last header before it.
    Rows of tables alone are exchanged.
    """
    of = [F.col(f"`{k}`") for k in keys]
    lines = docs.select(*of, F.xxhash64(text).alias("hash_"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    rows = lines.where(F.col("line").rlike(r"^[ \t]*\|[^\n]*\|[ \t]*\z")).dropDuplicates([*keys, "hash_", "pos"])
    turn = Window.partitionBy(*of, "hash_").orderBy("pos")
    bare = F.btrim("line", F.lit(BLANKS))
    cells = F.filter(F.transform(F.split(F.btrim(bare, F.lit("|")), r"\|"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    heads = (F.size(cells) >= 2) & ~F.exists(cells, lambda x: x.rlike(NUMBERS)) & (F.coalesce(F.lag("pos").over(turn), F.lit(-2)) != F.col("pos") - 1)
    marked = rows.withColumn("heads_", heads).withColumn("bare_", bare)
    headed = marked.withColumn("header", F.last(F.when(F.col("heads_"), F.col("bare_")), ignorenulls=True).over(turn))
    return headed.where(~F.col("heads_") & F.col("header").isNotNull()).select(*of, F.col("pos").cast("long").alias("pos"), "header")


def outlined(spark, d: str) -> DataFrame:
    """doc_id, text: the documents with every third line made a heading, by doc_id of an article, markdown or numbers, or every sixth an appendix."""
    n = F.col("doc_id")
    start = lambda x, i: F.substring(x, F.lit(1), 30 + i * 7 % 40)
    made = lambda x, i: (
        F.when(i % 3 != 0, x)
        .when(n % 4 == 0, F.concat(F.lit("제"), (i + 1).cast("string"), F.lit("조 "), start(x, i)))
        .when(n % 4 == 1, F.concat(F.repeat(F.lit("#"), (1 + (i + F.length(x)) % 4).cast("int")), F.lit(" "), x))
        .when(n % 4 == 2, F.concat(F.lit("1"), F.repeat(F.lit(".2"), ((i + F.length(x)) % 3).cast("int")), F.lit(" "), start(x, i)))
        .when(i % 6 == 0, F.concat(F.lit("별표 "), (i + 1).cast("string"), F.lit(" "), x))
        .otherwise(x)
    )
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.array_join(F.transform(lines_of(F.col("text")), made), "\n").alias("text"))


# The same texts and rules for DuckDB, by rows of lines and running sums instead of arrays.
_LINES = """l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
o AS (SELECT doc_id, i, CASE WHEN i % 3 <> 0 THEN x WHEN doc_id % 4 = 0 THEN concat('제', i + 1, '조 ', left(x, 30 + i * 7 % 40)) WHEN doc_id % 4 = 1 THEN concat(repeat('#', 1 + (i + length(x)) % 4), ' ', x)
 WHEN doc_id % 4 = 2 THEN concat('1', repeat('.2', (i + length(x)) % 3), ' ', left(x, 30 + i * 7 % 40)) WHEN i % 6 = 0 THEN concat('별표 ', i + 1, ' ', x) ELSE x END AS x FROM l)"""
_FORMS = (
    _LINES
    + f""", f AS (SELECT *, regexp_matches(x, '{GRAMMARS["article"]}') AS a, regexp_matches(x, '{GRAMMARS["markdown"]}') AS m, regexp_matches(x, '{GRAMMARS["numbered"]}') AS n, regexp_matches(x, '{APPENDIX}') AS p FROM o),
g AS (SELECT doc_id, CASE WHEN count(*) FILTER (a) >= 3 THEN 'article' WHEN count(*) FILTER (m) >= 3 THEN 'markdown' WHEN count(*) FILTER (n) >= 3 THEN 'numbered' ELSE 'none' END AS grammar, count(*) FILTER (p) AS apps FROM f GROUP BY doc_id),
h AS (SELECT f.*, grammar, (grammar <> 'none' OR apps >= 2) AND (p OR CASE grammar WHEN 'article' THEN a WHEN 'markdown' THEN m WHEN 'numbered' THEN n ELSE false END) AS heads FROM f JOIN g USING (doc_id)),
c AS (SELECT *, CAST(sum(heads::INT) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS part, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS flat FROM h)"""
)
_LABEL = f"CASE WHEN length(flat) <= 40 THEN nullif(trim(ltrim(flat, '#')), '') ELSE nullif(trim(regexp_extract(flat, '{NUMBERING}', 1)), '') END"
_SPLIT = (
    _FORMS
    + f""", s AS (SELECT doc_id, part, min(grammar) AS grammar, max(CASE WHEN heads THEN {_LABEL} END) AS label, max(CASE WHEN heads THEN length(flat) END) AS width,
 coalesce(string_agg(x, chr(10) ORDER BY i), '') AS all_lines, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT heads), '') AS below, max(x) FILTER (heads) AS head, count(*) AS n, bool_or(heads) AS headed, max(max(part)) OVER (PARTITION BY doc_id) AS parts FROM c GROUP BY doc_id, part),
b AS (SELECT doc_id, part, grammar, label, CASE WHEN parts = 0 THEN all_lines WHEN NOT headed THEN trim(all_lines, E' \\t\\n\\x0b\\f\\r') ELSE concat(CASE WHEN width > 40 THEN concat(head, chr(10)) ELSE '' END, below, CASE WHEN n > 1 AND part < parts THEN chr(10) ELSE '' END) END AS body FROM s
 WHERE parts = 0 OR headed OR trim(all_lines, E' \\t\\n\\x0b\\f\\r') <> '')"""
)


@frame(f"WITH {_FORMS} SELECT doc_id, grammar FROM g")
def detect_grammar(spark, d):
    """The grammar of each outlined document."""
    return outlined(spark, d).select("doc_id", grammar_of(lines_of(F.col("text"))).alias("grammar"))


@frame(f"WITH {_SPLIT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section, grammar, length(body) AS n_chars, md5(body) AS body_md5 FROM b")
def split_sections(spark, d):
    """The sections of each outlined document."""
    rows = split_texts(outlined(spark, d), ["doc_id"])
    return rows.select("doc_id", "section", "grammar", F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"))


@frame(f"WITH {_SPLIT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section, label FROM b")
def heading_label(spark, d):
    """The labels of the sections of each outlined document."""
    return split_texts(outlined(spark, d), ["doc_id"]).select("doc_id", "section", "label")


@frame(
    """WITH l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
t AS (SELECT doc_id, i, CASE WHEN i % 5 = 1 AND doc_id % 3 <> 0 THEN concat('| ', left(x, 9), ' | ', right(x, 9), ' |') ELSE concat('| ', left(x, 9), ' | ', i, ' |') END AS x FROM l WHERE i % 5 <> 0),
k AS (SELECT doc_id, i, trim(x) AS x, list_filter(list_transform(string_split(trim(trim(x), '|'), '|'), lambda c: trim(c)), lambda c: c <> '') AS cells FROM t),
f AS (SELECT doc_id, i, x, i % 5 = 1 AND len(cells) >= 2 AND len(list_filter(cells, lambda c: regexp_full_match(c, '[-0-9,.\\s]+'))) = 0 AS heads FROM k),
p AS (SELECT r.doc_id, r.i, max(h.i) AS at FROM f r JOIN f h ON h.doc_id = r.doc_id AND h.heads AND h.i < r.i WHERE NOT r.heads GROUP BY ALL)
SELECT p.doc_id, p.i AS pos, md5(f.x) AS header_md5 FROM p JOIN f ON f.doc_id = p.doc_id AND f.i = p.at"""
)
def table_headers(spark, d):
    """Documents whose lines, but every fifth, are rows of tables of two cells; a run begins with a header where doc_id does not divide by 3."""
    n = F.col("doc_id")
    row = lambda x, i: F.concat(F.lit("| "), F.substring(x, 1, 9), F.lit(" | "), F.when((i % 5 == 1) & (n % 3 != 0), F.right(x, F.lit(9))).otherwise(i.cast("string")), F.lit(" |"))
    made = F.transform(lines_of(F.col("text")), lambda x, i: F.when(i % 5 == 0, x).otherwise(row(x, i)))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(made, "\n").alias("text"))
    return table_rows(docs, ["doc_id"]).select("doc_id", "pos", F.md5("header").alias("header_md5"))


@frame(
    f"""WITH RECURSIVE {_FORMS}, k AS (SELECT doc_id, i, heads, part, i // 10 + 1 AS page, CASE WHEN p OR grammar = 'article' OR NOT heads THEN 1 WHEN grammar = 'markdown' THEN length(regexp_extract(x, '^[ \\t]*(#+)', 1))
 ELSE 1 + length(regexp_replace(regexp_extract(x, '^[ \\t]*([0-9]+([.][0-9]+)*)', 1), '[0-9]', '', 'g')) END AS level, CASE WHEN heads THEN coalesce({_LABEL}, CASE WHEN length(flat) > 40 THEN concat(rtrim(left(flat, 40)), '…') END) END AS label
 FROM c WHERE heads OR i % 11 <> 10),
s AS (SELECT doc_id, part, max(CASE WHEN heads THEN level END) AS level, max(label) AS label, count(*) FILTER (NOT heads) AS n_blocks, min(page) AS page_from, max(page) AS page_to FROM k GROUP BY doc_id, part),
above AS (SELECT s.doc_id, s.part, max(q.part) AS up FROM s LEFT JOIN s q ON q.doc_id = s.doc_id AND q.part < s.part AND q.level < s.level GROUP BY ALL),
r AS (SELECT doc_id, part, CASE WHEN label IS NULL THEN '' ELSE label END AS path, part AS at FROM s
 UNION ALL SELECT r.doc_id, r.part, CASE WHEN s.label IS NULL THEN r.path WHEN r.path = '' THEN s.label ELSE concat(s.label, ' > ', r.path) END, s.part FROM r JOIN above u ON u.doc_id = r.doc_id AND u.part = r.at JOIN s ON s.doc_id = u.doc_id AND s.part = u.up),
top AS (SELECT r.doc_id, r.part, r.path FROM r JOIN above u ON u.doc_id = r.doc_id AND u.part = r.at WHERE u.up IS NULL)
SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.part) - 1 AS section, top.path AS path, n_blocks, page_from, page_to FROM s JOIN top ON top.doc_id = s.doc_id AND top.part = s.part"""
)
def breadcrumbs(spark, d):
    """Sections of blocks: the lines of the outlined documents, ten a page, those at 10, 21 and so on page numbers unless they are headings."""
    lined = outlined(spark, d).withColumn("lines", lines_of(F.col("text"))).withColumn("grammar", grammar_of(F.col("lines")))
    apps = F.size(F.filter("lines", lambda x: x.rlike(APPENDIX)))
    rows = lined.select("doc_id", "grammar", ((F.col("grammar") != "none") | (apps >= APPENDICES_NEEDED)).alias("split"), F.posexplode("lines").alias("pos", "text"))
    heads = F.col("split") & (F.col("text").rlike(APPENDIX) | is_heading(F.col("text"), F.col("grammar")))
    kind = F.when(heads, "heading").when(F.col("pos") % 11 == 10, "page_number").otherwise("paragraph")
    blocks = rows.select("doc_id", "pos", kind.alias("type"), F.when(heads, level_of(F.col("text"), F.col("grammar"))).alias("level"), "text", (F.floor(F.col("pos") / 10) + 1).alias("page"), F.lit(False).alias("synthetic"))
    return build_sections(blocks, ["doc_id"]).select("doc_id", "section", F.array_join("path", " > ").alias("path"), "n_blocks", "page_from", "page_to")
