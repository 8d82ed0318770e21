"""Document-level search (inventory F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.retrieval import corpus, dense_top, read, source_vectors, vector_queries, vectors
from tessera.operators.vectors import doc_max
from tessera.plans.dialect import DUCK
from tessera.registry import frame, sql


#: Hits of a query that are grouped, and what the second best adds to a document's score.
POOL, SECOND = 60, 0.15

HITS_SQL = f"""h AS (SELECT q.vec_id AS query_id, x.source AS doc, x.lang AS page, c.vec_id AS chunk_id, round({DUCK.dot('q.embedding', 'c.embedding')}, 6) AS score
FROM embeddings c JOIN documents x ON x.doc_id = c.vec_id JOIN embeddings q ON q.vec_id % 50 = 0),
pool AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rk FROM h) z WHERE rk <= 60)"""


def pool(spark, d, queries: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rk, doc, page: the best hits of each vector query, documents as their sources."""
    known = corpus(spark, d).select("chunk_id")
    queries = vector_queries(spark, d) if queries is None else queries
    found = dense_top(vectors(spark, d).join(known, "chunk_id", "left_semi"), queries, POOL).withColumnRenamed("rank", "rk")
    of = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), F.col("lang").alias("page"))
    return found.join(of, "chunk_id")


def docs_of(hits: DataFrame) -> DataFrame:
    """query_id, doc, score, n_hits, place: a document's score is its best hit and SECOND of the second, if that is positive; the first 20."""
    scores = F.sort_array(F.collect_list("score"), asc=False)  # at most POOL
    own = hits.groupBy("query_id", "doc").agg(scores.alias("s"), F.count(F.lit(1)).alias("n_hits"))
    score = F.col("s")[0] + SECOND * F.greatest(F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")
    return own.select("query_id", "doc", (F.round(score * 1e6) / 1e6).alias("score"), "n_hits").withColumn("place", F.row_number().over(order).cast("long")).where("place <= 20")


@frame(
    f"""WITH {HITS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, chunk_id) AS n FROM pool),
s AS (SELECT query_id, doc, round(CAST(max(CASE WHEN n = 1 THEN score END) + 0.15 * greatest(coalesce(max(CASE WHEN n = 2 THEN score END), 0), 0) AS DOUBLE), 6) AS score, count(*) AS n_hits FROM k GROUP BY query_id, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM s) SELECT query_id, doc, score, n_hits, CAST(place AS BIGINT) AS place FROM r WHERE place <= 20"""
)
def find_docs(spark, d):
    """Documents of the best score for each vector query."""
    return docs_of(pool(spark, d))


@frame(
    f"""WITH {HITS_SQL}, g AS (SELECT query_id, doc, page, min(rk) AS first_hit, count(*) AS n, max(score) AS best FROM pool GROUP BY query_id, doc, page)
SELECT query_id, doc, page, CAST(first_hit AS BIGINT) AS first_hit, best, CAST(greatest(n - 8, 0) AS BIGINT) AS more, CAST(row_number() OVER (PARTITION BY query_id, doc ORDER BY first_hit) AS BIGINT) AS page_no FROM g"""
)
def find_pages(spark, d):
    """Pages of each document in the order of their first hit; more than eight hits of a page are told as a number."""
    g = pool(spark, d).groupBy("query_id", "doc", "page").agg(F.min("rk").cast("long").alias("first_hit"), F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    order = Window.partitionBy("query_id", "doc").orderBy("first_hit")
    return g.select("query_id", "doc", "page", "first_hit", "best", F.greatest(F.col("n") - 8, F.lit(0)).cast("long").alias("more"), F.row_number().over(order).cast("long").alias("page_no"))


@sql
def name_hits(d):
    """Documents whose name holds at least two of an item's words (or its only one); the five first."""
    return f"""WITH q AS (SELECT item_id, {d.each(d.distinct(d.words("lower(text)")), 'w')} FROM {d.table('benchmark')}), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
x AS (SELECT doc_id, {d.each(d.distinct(d.words('lower(text)')), 'w')} FROM {d.table('documents')}), m AS (SELECT q.item_id, x.doc_id, count(*) AS hits FROM q JOIN x ON x.w = q.w GROUP BY q.item_id, x.doc_id),
r AS (SELECT m.item_id, m.doc_id, m.hits, row_number() OVER (PARTITION BY m.item_id ORDER BY m.hits DESC, m.doc_id) AS k FROM m JOIN n ON n.item_id = m.item_id WHERE m.hits >= least(2, n.n))
SELECT item_id, doc_id, hits FROM r WHERE k <= 5"""


@sql
def page_text(d):
    return f"SELECT conv_id, md5({d.ordered('text', 'turn', '~')}) AS text_md5, count(*) AS n FROM {d.table('conversations')} GROUP BY conv_id"


#: Chunks that stand for a document.
SAMPLED = 32

_SAMPLED_SQL = f"""c AS (SELECT x.source AS doc, e.vec_id, e.embedding, row_number() OVER (PARTITION BY x.source ORDER BY e.vec_id) - 1 AS i, count(*) OVER (PARTITION BY x.source) AS n FROM embeddings e JOIN documents x ON x.doc_id = e.vec_id),
q AS (SELECT doc, vec_id, embedding FROM c WHERE (32 * i) % n = 0 OR n - (32 * i) % n < 32),
nq AS (SELECT doc, count(*) AS k FROM q GROUP BY doc),
best AS (SELECT q.doc AS a, c.doc AS b, q.vec_id AS qv, max(round({DUCK.dot('q.embedding', 'c.embedding')}, 6)) AS s FROM q JOIN c ON q.doc <> c.doc GROUP BY q.doc, c.doc, q.vec_id)"""


def sampled_best(spark, d) -> tuple[DataFrame, DataFrame]:
    """Evenly spaced chunks of each source (numbers floor(k * n / 32), at most 32) against the other sources: a, b, qv, s; and a, k, their number."""
    held = source_vectors(spark, d)
    at = Window.partitionBy("doc").orderBy("chunk_id")
    i, n = F.row_number().over(at) - 1, F.count(F.lit(1)).over(Window.partitionBy("doc"))
    step = (SAMPLED * F.col("i")) % F.col("n")
    queries = held.withColumn("i", i).withColumn("n", n).where((step == 0) | (F.col("n") - step < SAMPLED)).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("q"), F.col("doc").alias("a"))
    of = queries.select("query_id", "a")
    best = doc_max(held, queries).join(of, "query_id").where("doc <> a").select("a", F.col("doc").alias("b"), F.col("query_id").alias("qv"), F.col("best").alias("s"))
    return best, of.groupBy("a").agg(F.count(F.lit(1)).alias("k"))


@frame(
    f"""WITH {_SAMPLED_SQL}, s AS (SELECT a, b, round(sum(s) / max(nq.k), 6) AS score FROM best JOIN nq ON nq.doc = a GROUP BY a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s) SELECT a, b, score, CAST(k AS BIGINT) AS place FROM r WHERE k <= 20"""
)
def similar_docs(spark, d):
    """Mean of the best scores over all query vectors of the source, missing ones included."""
    best, n = sampled_best(spark, d)
    score = F.round(F.sum(F.col("s").cast("decimal(20,6)")).cast("double") / F.max("k"), 6)
    order = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return best.join(n, "a").groupBy("a", "b").agg(score.alias("score")).withColumn("place", F.row_number().over(order).cast("long")).where("place <= 20")


@frame(f"WITH {_SAMPLED_SQL}, r AS (SELECT a, b, qv, s, row_number() OVER (PARTITION BY a, b ORDER BY s DESC, qv) AS k FROM best) SELECT a, b, qv, s, CAST(k AS BIGINT) AS k FROM r WHERE k <= 2")
def similar_pairs(spark, d):
    """The two pairs that speak most for a likeness of two sources."""
    order = Window.partitionBy("a", "b").orderBy(F.col("s").desc(), "qv")
    return sampled_best(spark, d)[0].withColumn("k", F.row_number().over(order).cast("long")).where("k <= 2")


@sql
def similar_collapse(d):
    return f"""WITH r AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM {d.table('documents')})
SELECT min(doc_id) AS doc_id, {d.ordered('CAST(doc_id AS STRING)', 'doc_id', ',')} AS folded, count(*) AS n FROM r GROUP BY h HAVING count(*) > 1"""


@sql
def keep_page(d):
    """Up to 300 pages all, else 64 spots; pages of a source are its documents."""
    return f"""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {d.table('documents')})
SELECT source, doc_id FROM p WHERE n <= 300 OR floor(i * 64.0 / n) <> floor((i - 1) * 64.0 / n)"""


@sql
def summary_text(d):
    """Eight lines, evenly spaced, 175 characters of each."""
    return f"""WITH l AS (SELECT doc_id, {d.each_at(d.lines('text'), 'pos', 'line')} FROM {d.table('documents')}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l)
SELECT doc_id, md5({d.ordered('substring(line, 1, 175)', 'pos', ' ')}) AS summary_md5, count(*) AS picked FROM n WHERE n <= 8 OR floor(pos * 8.0 / n) <> floor((pos - 1) * 8.0 / n) GROUP BY doc_id"""


@sql
def overview_pick(d):
    """The first two, the middle and the last document of a source."""
    return f"""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {d.table('documents')})
SELECT source, doc_id, CAST(i AS BIGINT) AS i FROM p WHERE i IN (0, 1) OR i = CAST(floor(n / 2.0) AS BIGINT) OR i = n - 1"""


@sql
def bigram_overlap(d):
    """Shared character pairs of neighbouring items by the smaller set."""
    grams = lambda c: d.distinct(d.map(d.sequence("1", f"greatest(length({c}) - 1, 1)"), "k", f"substring({c}, CAST(k AS INT), 2)"))
    return f"""WITH p AS (SELECT a.item_id, {grams('a.text')} AS x, {grams('b.text')} AS y FROM {d.table('benchmark')} a JOIN {d.table('benchmark')} b ON b.item_id = a.item_id + 1)
SELECT item_id, round(CAST({d.size(d.both('x', 'y'))} AS DOUBLE) / least({d.size('x')}, {d.size('y')}), 6) AS overlap FROM p"""
