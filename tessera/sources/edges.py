"""Running heads, running feet and page numbers among the lines of pages (inventory S14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.registry import frame

# Lines looked at on each edge of a page, pages that must share a line, longest line, fewest letters and digits but for numbers.
EDGE, PAGES, LONGEST, LETTERS = 2, 3, 60, 4
# What a page number looks like.
PAGE_NUMBER = r"(?i)^((-|–|—)?\s*[0-9]{1,4}\s*(-|–|—)?|[0-9]{1,4}\s*/\s*[0-9]{1,4}|(page|p[.]?)\s*[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?)$"
SPACE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"


def page_edges(lines: DataFrame) -> DataFrame:
    """doc, page, pos, kind: the lines (doc, page, pos, text) that are a `header`, a `footer` or a `page_number`.

    The two first and last lines with text of each page are looked at. One that only numbers the page is a page number. A line of at most 60
    characters, equal but for digits and spacing to one of the same edge on three pages of the document or more, is a header or footer, all
    but its first place, which stays text. Lines of fewer than four letters beside numbers never are. A line on both edges is a header first.
    Edges are ranked within single pages; equal lines of a document are counted, not gathered. Nulls are lines without text.
    """
    text = F.regexp_replace("text", f"^{SPACE}+|{SPACE}+$", "")
    page = Window.partitionBy("doc", "page")
    shown = lines.select("doc", "page", "pos", text.alias("text")).where("text <> ''")
    ranked = shown.select("*", F.row_number().over(page.orderBy("pos")).alias("above"), F.row_number().over(page.orderBy(F.desc("pos"))).alias("below"))
    edge = ranked.where((F.col("above") <= EDGE) | (F.col("below") <= EDGE)).withColumn("numbers", F.col("text").rlike(PAGE_NUMBER))
    key = F.regexp_replace(F.regexp_replace("text", f"{SPACE}+", " "), "[0-9]+", "#")
    sides = F.array_compact(F.array(F.when(F.col("above") <= EDGE, "header"), F.when(F.col("below") <= EDGE, "footer")))
    asked = edge.where(~F.col("numbers") & (F.length("text") <= LONGEST)).select("doc", "page", "pos", key.alias("key"), F.explode(sides).alias("kind"))
    asked = asked.where(F.length(F.regexp_replace("key", r"[^\p{L}\p{N}]+", "")) >= LETTERS)
    spots = asked.groupBy("doc", "kind", "key").agg(F.min(F.struct("page", "pos")).alias("first"), F.countDistinct("page").alias("on")).where(F.col("on") >= PAGES)
    # A document of null id is one document.
    asked, spots = asked.alias("a"), spots.alias("s")
    met = asked.join(spots, F.col("a.doc").eqNullSafe(F.col("s.doc")) & (F.col("a.kind") == F.col("s.kind")) & (F.col("a.key") == F.col("s.key"))).where(F.struct("a.page", "a.pos") != F.col("s.first"))
    running = met.groupBy("a.doc", "a.page", "a.pos").agg(F.max("a.kind").alias("kind"))
    return running.unionByName(edge.where("numbers").select("doc", "page", "pos", F.lit("page_number").alias("kind")))


@frame(
    r"""WITH l AS (SELECT source AS doc, doc_id AS page, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS text FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT doc, page, pos, regexp_replace(text, '^[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+|[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+$', '', 'g') AS text FROM l),
a AS (SELECT doc, page, list(struct_pack(pos := pos, text := text) ORDER BY pos) AS ls FROM t WHERE text <> '' GROUP BY doc, page),
s AS (SELECT doc, page, 'header' AS kind, unnest(ls[1:2]) AS x FROM a UNION ALL SELECT doc, page, 'footer', unnest(ls[-2:]) FROM a),
n AS (SELECT doc, page, kind, x.pos AS pos, x.text AS text, regexp_matches(x.text, '(?i)^((-|–|—)?\s*\d{1,4}\s*(-|–|—)?|\d{1,4}\s*/\s*\d{1,4}|(page|p[.]?)\s*\d{1,4}(\s*(of|/)\s*\d{1,4})?)$') AS num,
 regexp_replace(regexp_replace(x.text, '[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+', ' ', 'g'), '\d+', '#', 'g') AS key FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, kind, key ORDER BY page, pos) AS place, count(DISTINCT page) OVER (PARTITION BY doc, kind, key) AS on_pages
 FROM n WHERE NOT num AND length(text) <= 60 AND length(regexp_replace(key, '[^\p{L}\p{N}]+', '', 'g')) >= 4)
SELECT doc, page, pos, CASE WHEN bool_or(kind = 'header') THEN 'header' ELSE 'footer' END AS kind FROM r WHERE on_pages >= 3 AND place > 1 GROUP BY doc, page, pos
UNION ALL SELECT DISTINCT doc, page, pos, 'page_number' FROM n WHERE num"""
)
def running_lines(spark, d):
    """Sources as documents, their texts as pages."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return page_edges(docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "text")))
