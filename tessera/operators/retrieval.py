"""Lexical index, dense vectors, fusion and selection (inventory B, V, R).

Queries are a small side (a row each, checked before it is broadcast); the corpus side streams past them and only per-query
top-k rows move. Statistics (documents, frequencies, mean length) come from the whole corpus, also where a scope applies.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import doc_max, nearest
from tessera.plans.dialect import DUCK
from tessera.registry import frame, sql

K1, B, RRF_K, FIRST_K, TOP_K = 1.5, 0.75, 60, 10, 3
SMALL_ROWS = 200_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is known to have at most rows rows and these are few: its plan is not run to count them."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def words(text):
    return F.filter(F.split(F.trim(text), r"[ \t\n\x0b\f\r]+"), lambda x: x != "")


def read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than these; the rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def shared_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one in a session without a cluster."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not (conf.get("spark.master") or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/tessera-index/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written and read back: what is read in several steps is computed once."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id and its distinct terms: those of a whole benchmark item."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(words(F.col("text"))).alias("terms"))


def top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_TOKENS = "list_filter(string_split_regex(trim(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
BM25_SQL = f"""
parted AS MATERIALIZED (SELECT doc_id AS chunk_id, {_TOKENS} AS w FROM documents),
sized AS MATERIALIZED (SELECT chunk_id, len(w) AS dl, w FROM parted),
tok AS MATERIALIZED (SELECT chunk_id, dl, unnest(w) AS term FROM sized),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
q AS MATERIALIZED (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
post AS MATERIALIZED (SELECT chunk_id, dl, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM q JOIN post USING (term) JOIN df USING (term), stats GROUP BY query_id, chunk_id),
bmtop AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 10)
"""


def lexical(spark, d, k: int, inside: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25: postings of the stored index are read, not texts."""
    from tessera.operators import index  # it builds on this module

    return index.search_top(spark, index.index_of(spark, d), text_queries(spark, d) if queries is None else queries, k, inside)


def corpus(spark, d):
    return spread(read(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), "text", "source")


@frame(f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, rank FROM bmtop")
def bm25_topk(spark, d):
    """The ten best documents of each item, from the stored index of the documents."""
    return lexical(spark, d, FIRST_K)


@frame(f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm JOIN documents ON doc_id = chunk_id WHERE score > 0 AND source = 'src1' QUALIFY rank <= 10")
def bm25_scoped(spark, d):
    """Chunks of one source; statistics stay those of the corpus."""
    return lexical(spark, d, FIRST_K, corpus(spark, d).where("source = 'src1'").select("chunk_id"))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k nearest by cosine of unit vectors for queries (query_id, q) over vectors (chunk_id, v).

    Pending chunks have no vector. Vectors of another length than the query's never rank.
    """
    return top(nearest(vectors, queries, k).withColumn("score", F.round("score", 6)), k)


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"))


_DENSE = "dn AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b {join} WHERE a.vec_id % 50 = 0), dntop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= 10)"


@frame(f"WITH {_DENSE.format(join='')} SELECT * FROM dntop")
def dense_topk(spark, d):
    return dense_top(vectors(spark, d), vector_queries(spark, d), FIRST_K)


@frame(f"WITH {_DENSE.format(join='JOIN documents x ON x.doc_id = b.vec_id')} SELECT * FROM dntop")
def dense_pending(spark, d):
    """Vectors of known chunks alone; chunks without a vector never rank."""
    known = corpus(spark, d).select("chunk_id")
    return dense_top(vectors(spark, d).join(known, "chunk_id", "left_semi"), vector_queries(spark, d), FIRST_K)


def fused(lists: list[DataFrame]) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, chunk_id, rank); ties by first appearance, list by list."""
    rows = None
    for k, x in enumerate(lists):
        own = x.select("query_id", "chunk_id", "rank", F.lit(k).alias("list_no"))
        rows = own if rows is None else rows.unionByName(own)
    sums = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.min(F.col("list_no") * 1000 + F.col("rank")).alias("first_seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first_seen", "chunk_id")
    return sums.withColumn("rank", F.row_number().over(order))


def query_vectors(spark, d):
    """Vector queries of the text queries: the embedding with the item's number."""
    v, q = vectors(spark, d), text_queries(spark, d)
    return v.join(q.select("query_id"), v.chunk_id == F.col("query_id")).select("query_id", F.col("v").alias("q"))


_HYBRID = f"""{BM25_SQL},
dn AS (SELECT i.item_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
       FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b JOIN documents x ON x.doc_id = b.vec_id),
dntop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= 10),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(l * 1000 + rank) AS first_seen
      FROM (SELECT query_id, chunk_id, rank, 0 AS l FROM dntop UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bmtop) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, chunk_id) AS rank FROM f)"""


def first_stage(spark, d) -> DataFrame:
    known = corpus(spark, d).select("chunk_id")
    dense = dense_top(vectors(spark, d).join(known, "chunk_id", "left_semi"), query_vectors(spark, d), FIRST_K)
    return fused([dense, bm25_topk(spark, d)])


@frame(f"WITH {_HYBRID} SELECT query_id, chunk_id, score, first_seen, rank FROM fr")
def rrf_fusion(spark, d):
    return first_stage(spark, d).select("query_id", "chunk_id", "score", F.col("first_seen").cast("long").alias("first_seen"), "rank")


def dedup_key(text):
    bare = F.regexp_replace(text, r"\s+", "")
    return F.when(bare != "", F.md5(bare))


def dedup_backfill(ranked: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, chunk_id, rank, key): first of each key, then the dropped in order, k in all; a null key is never a duplicate."""
    same = Window.partitionBy("query_id", F.coalesce("key", F.concat(F.lit("#"), F.col("chunk_id").cast("string")))).orderBy("rank")
    out = ranked.withColumn("dup_no", F.row_number().over(same))
    order = Window.partitionBy("query_id").orderBy((F.col("dup_no") > 1).cast("int"), "rank")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


@frame(
    f"""WITH {_HYBRID},
k AS (SELECT fr.*, CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN md5(regexp_replace(text, '\\s+', '', 'g')) END AS key FROM fr JOIN documents ON doc_id = chunk_id),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(key, '#' || chunk_id) ORDER BY rank) AS dup_no FROM k)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN dup_no > 1 THEN 1 ELSE 0 END, rank) AS place FROM dd QUALIFY place <= 3"""
)
def hybrid_search(spark, d):
    """Dense and BM25 lists, fused, texts joined after the top-k, copies last, three pieces of evidence a query."""
    ranked = first_stage(spark, d)
    found = corpus(spark, d).join(bounded(ranked, 2 * FIRST_K * read(spark, d, "benchmark").count()), "chunk_id").select("query_id", "chunk_id", "score", "rank", dedup_key(F.col("text")).alias("key"))
    return dedup_backfill(found, TOP_K).select("query_id", "chunk_id", "score", "place")


@frame(
    f"""WITH {BM25_SQL},
k AS (SELECT bmtop.*, CASE WHEN regexp_replace(text, '\\s+', '', 'g') <> '' THEN md5(regexp_replace(text, '\\s+', '', 'g')) END AS key FROM bmtop JOIN documents ON doc_id = chunk_id),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(key, '#' || chunk_id) ORDER BY rank) AS dup_no FROM k)
SELECT query_id, chunk_id, dup_no, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN dup_no > 1 THEN 1 ELSE 0 END, rank) AS place FROM dd QUALIFY place <= 5"""
)
def dedup_evidence(spark, d):
    ranked = bm25_topk(spark, d)
    found = corpus(spark, d).join(bounded(ranked, 2 * FIRST_K * read(spark, d, "benchmark").count()), "chunk_id").select("query_id", "chunk_id", "rank", dedup_key(F.col("text")).alias("key"))
    return dedup_backfill(found, 5).select("query_id", "chunk_id", "dup_no", "place")


@sql
def lookup_ids(d):
    return f"SELECT x.doc_id, x.source, x.n_chars FROM {d.table('documents')} x JOIN {d.table('benchmark')} i ON x.doc_id = i.item_id"


@sql
def folder_scope(d):
    """Folder src1 never takes in src10."""
    path = "concat('/corpus/', lang, '/', source, '/', CAST(doc_id AS STRING), '.txt')"
    return f"SELECT doc_id, {path} AS doc_path FROM {d.table('documents')} WHERE {d.starts('lower(' + path + ')', "concat(lower('/corpus/EN/src1'), '/')")}"


@sql
def docs_scope(d):
    return f"SELECT vec_id, label FROM {d.table('embeddings')} WHERE vec_id IN (SELECT doc_id FROM {d.table('documents')} WHERE source IN ('src1', 'src2'))"


DOC_MAX_SQL = f"""WITH s AS (SELECT q.vec_id AS query_id, x.source, c.vec_id AS chunk_id, round({DUCK.dot('q.embedding', 'c.embedding')}, 6) AS score
FROM embeddings c JOIN documents x ON x.doc_id = c.vec_id JOIN embeddings q ON q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rn, count(*) OVER (PARTITION BY query_id, source) AS n_chunks FROM s)
SELECT query_id, source, chunk_id AS best_chunk, score, CAST(n_chunks AS BIGINT) AS n_chunks FROM k WHERE rn = 1"""


def source_vectors(spark, d) -> DataFrame:
    """chunk_id, v, doc: vectors of known chunks with their source as the document."""
    known = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")).join(known, "chunk_id")


@frame(DOC_MAX_SQL)
def doc_max_scan(spark, d):
    """Best score of each source document for each query vector, with the chunk that has it, and its number of chunks."""
    found = doc_max(source_vectors(spark, d), vector_queries(spark, d))
    return found.select("query_id", F.col("doc").alias("source"), F.col("chunk_id").alias("best_chunk"), F.col("best").alias("score"), F.col("n").alias("n_chunks"))


@sql
def l2_normalize(d):
    return f"SELECT vec_id, round(sqrt({d.dot('embedding', 'embedding')}), 4) AS norm, {d.size('embedding')} AS dims FROM {d.table('embeddings')}"


@sql
def centroids(d):
    return f"""WITH e AS (SELECT label, {d.each_at('embedding', 'dim', 'x')} FROM {d.table('embeddings')})
SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY label, dim"""


@sql
def reuse_vectors(d):
    """Old vectors to new chunks with the same text, one to one."""
    t = d.table("documents")
    return f"""WITH o AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM {t} WHERE doc_id % 2 = 0),
n AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM {t} WHERE doc_id % 2 = 1)
SELECT n.doc_id AS new_id, o.doc_id AS old_id FROM n JOIN o ON o.h = n.h AND o.k = n.k"""


@sql
def tokenize(d):
    return f"WITH w AS (SELECT doc_id, {d.words('text')} AS t FROM {d.table('documents')}) SELECT doc_id, CAST({d.size('t')} AS BIGINT) AS n_tokens, md5({d.join('t', ' ')}) AS tokens_md5 FROM w"


@sql
def term_freqs(d):
    return f"WITH w AS (SELECT doc_id, {d.each(d.words('text'), 'term')} FROM {d.table('documents')}) SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term"


@sql
def postings(d):
    return f"""WITH w AS (SELECT doc_id, {d.each(d.words('text'), 'term')} FROM {d.table('documents')}), p AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY term, doc_id)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(doc_id) AS first_doc, max(tf) AS max_tf FROM p GROUP BY term"""


@sql
def bm25_plan_update(d):
    t = d.table("documents")
    return f"""WITH live AS (SELECT doc_id FROM {t} WHERE doc_id % 7 <> 0), have AS (SELECT doc_id FROM {t} WHERE doc_id % 5 <> 0)
SELECT doc_id, 'add' AS op FROM live l WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.doc_id = l.doc_id)
UNION ALL SELECT doc_id, 'remove' AS op FROM have h WHERE NOT EXISTS (SELECT 1 FROM live l WHERE h.doc_id = l.doc_id)"""


@sql
def bm25_should_merge(d):
    return f"""WITH c AS (SELECT source, count(*) AS base, {d.at_least_count('doc_id % 19 = 0')} AS adds, {d.at_least_count('doc_id % 23 = 0')} AS dead FROM {d.table('documents')} GROUP BY source)
SELECT source, base, adds, dead, (adds > 0.05 * base OR dead > 0.05 * base) AS merge FROM c"""


@sql
def bm25_incremental(d):
    """Document frequencies of base plus delta less tombstones: those of a full rebuild."""
    t = d.table("documents")
    w = lambda c: f"SELECT doc_id, {d.each(d.distinct(d.words('text')), 'term')} FROM {t} WHERE {c}"
    return f"""WITH base AS ({w('doc_id % 10 < 8')}), delta AS ({w('doc_id % 10 >= 8')}),
live AS (SELECT * FROM base WHERE doc_id % 17 <> 0 UNION ALL SELECT * FROM delta)
SELECT term, count(*) AS df FROM live GROUP BY term"""


@sql
def keywords(d):
    k = d.filter(d.rx_all("lower(text)", "[a-z0-9]+"), "w", "length(w) >= 2 AND w NOT IN ('what', 'about', 'this', 'the', 'is', 'it')")
    return f"SELECT item_id, {d.join(k, ' ')} AS keywords, CAST({d.size(k)} AS BIGINT) AS n FROM {d.table('benchmark')}"
