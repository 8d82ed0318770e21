"""Files and their scan (inventory S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import frame, sql

# Extensions that are indexed.
EXTENSIONS = ["pdf", "docx", "doc", "hwp", "hwpx", "pptx", "xlsx", "txt", "md", "csv", "log", "rtf"]
CLASSES = {"word": ["doc", "docx", "rtf"], "excel": ["xls", "xlsx", "csv"], "ppt": ["ppt", "pptx"], "hwp": ["hwp", "hwpx"], "pdf": ["pdf"], "text": ["txt", "md", "log"]}


def scan(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """path, modified, size of the indexed files below root; transient and hidden ones left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.where(ext.isin(extensions) & ~name.startswith("~$") & ~name.startswith(".")).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


@frame()
def scan_files(spark, d):
    return scan(spark, d, ["parquet"]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


def files(d):
    kinds = ["txt", "PDF", "docx", "xlsx", "exe", "md"]
    case = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(kinds))
    return f"f AS (SELECT doc_id, concat(CASE WHEN doc_id % 17 = 0 THEN '~$' ELSE '' END, source, '/', CAST(doc_id AS STRING), '.', CASE doc_id % 6 {case} END) AS path, n_chars FROM {d.table('documents')})"


@sql
def ext_filter(d):
    names = ", ".join(f"'{x}'" for x in EXTENSIONS)
    return f"WITH {files(d)} SELECT doc_id, path FROM f WHERE lower({d.rx_get('path', '[.]([^.]+)$', 1)}) IN ({names}) AND NOT {d.starts('path', chr(39) + '~$' + chr(39))}"


@sql
def format_of_ext(d):
    ext = f"lower({d.rx_get('path', '[.]([^.]+)$', 1)})"
    case = " ".join(f"WHEN {ext} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in CLASSES.items())
    return f"WITH {files(d)} SELECT doc_id, CASE {case} ELSE 'other' END AS format FROM f"


@sql
def fingerprint(d):
    sha = "sha1" if d.name == "spark" else "sha1"
    return f"WITH {files(d)} SELECT doc_id, {sha}(concat(path, '|', CAST(1700000000 + doc_id AS STRING), '|', CAST(n_chars AS STRING))) AS fingerprint FROM f"


@sql
def content_hash(d):
    return f"SELECT doc_id, sha1(text) AS content_hash FROM {d.table('documents')}"


@sql
def skip_folders(d):
    skip = ", ".join(f"'{x}'" for x in ("src3", "src7"))
    return f"WITH {files(d)} SELECT doc_id FROM f WHERE {d.rx_get('path', '^(?:~[$])?([^/]+)/', 1)} NOT IN ({skip})"


@sql
def edge_lines(d):
    """Lines that stand first or last in several documents of a source: headers and footers."""
    return f"""WITH l AS (SELECT source, doc_id, {d.each_at(d.lines('text'), 'pos', 'line')} FROM {d.table('documents')}) , e AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT source, md5(line) AS line_md5, {d.at_least_count('pos = 0')} AS heads, {d.at_least_count('pos = last')} AS feet, count(DISTINCT doc_id) AS docs FROM e WHERE pos = 0 OR pos = last GROUP BY source, md5(line) HAVING count(DISTINCT doc_id) >= 2"""


@sql
def html_counts(d):
    n = lambda t: f"CAST({d.size(d.rx_all('html', '<' + t + '[ >]'))} AS BIGINT)"
    return f"SELECT page_id, {n('h1')} AS h1, {n('h2')} AS h2, {n('p')} AS p, {n('li')} AS li, {n('nav')} AS nav FROM {d.table('pages')}"
