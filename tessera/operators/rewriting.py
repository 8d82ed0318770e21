"""Query rewriting (inventory Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.retrieval import dense_top, vector_queries, vectors
from tessera.plans.dialect import DUCK
from tessera.registry import frame, sql


@sql
def multiturn_queries(d):
    return f"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {d.table('conversations')} WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN prev IS NULL THEN text ELSE concat(prev, ' ', text) END AS search_text FROM u"""


@sql
def query_misses(d):
    return f"SELECT event_id, user_id, value FROM {d.table('events')} WHERE value < 0 OR event_type = 'error'"


@sql
def read_misses(d):
    """Distinct questions in the order first seen, with their number; the last 200."""
    return f"""WITH g AS (SELECT text AS q, count(*) AS n, min(conv_id * 100 + turn) AS first_at FROM {d.table('conversations')} WHERE role = 'user' GROUP BY text),
r AS (SELECT *, row_number() OVER (ORDER BY first_at DESC, q) AS k FROM g) SELECT q, n, first_at FROM r WHERE k <= 200"""


@sql
def synonym_rules(d):
    """The user's rule of a word wins over the built-in one; rejected pairs go."""
    p = d.table("part")
    return f"""WITH rules AS (SELECT p_type AS word, min(p_name) AS term, 1 AS prio FROM {p} WHERE p_partkey % 2 = 0 GROUP BY p_type UNION ALL SELECT p_type, max(p_name), 2 FROM {p} GROUP BY p_type),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY prio, term) AS k FROM rules), rejected AS (SELECT p_type AS word, p_name AS term FROM {p} WHERE p_partkey % 50 = 0)
SELECT word, term FROM r WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM rejected x WHERE x.word = r.word AND x.term = r.term)"""


@sql
def words_and_terms(d):
    """Words of a question that no retrieved text holds."""
    t = d.table("documents")
    return f"""WITH q AS (SELECT item_id, {d.each(d.distinct(d.words('lower(text)')), 'word')} FROM {d.table('benchmark')}), x AS (SELECT doc_id, {d.each(d.distinct(d.words('lower(text)')), 'word')} FROM {t})
SELECT q.item_id, q.word FROM q LEFT JOIN x ON x.doc_id = q.item_id AND x.word = q.word WHERE x.word IS NULL"""


@frame(
    f"""WITH s AS (SELECT w.vec_id AS word, t.vec_id AS term, round({DUCK.dot('w.embedding', 't.embedding')}, 6) AS score FROM embeddings w JOIN embeddings t ON w.vec_id % 50 = 0 AND t.vec_id % 50 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, term) AS rk FROM s)
SELECT term, count(*) AS votes, CAST(min(rk) AS BIGINT) AS best_rank, max(score) AS best FROM r WHERE rk <= 3 GROUP BY term"""
)
def synonym_suggest(spark, d):
    """For each word's vector the three closest terms; votes, best rank and best score over all words."""
    terms = vectors(spark, d).where("chunk_id % 50 <> 0")
    found = dense_top(terms, vector_queries(spark, d), 3)
    return found.groupBy(F.col("chunk_id").alias("term")).agg(F.count(F.lit(1)).alias("votes"), F.min("rank").cast("long").alias("best_rank"), F.max("score").alias("best"))


@sql
def clean_question(d):
    return f"SELECT conv_id, turn, trim({d.rx_sub(d.rx_sub('text', '^[?？]+', ''), '[ \\t\\r\\n]+', ' ')}) AS question FROM {d.table('conversations')} WHERE role = 'user' AND length(trim(text)) >= 2"


@sql
def is_question(d):
    return f"SELECT conv_id, turn, ({d.rx_has('lower(text)', '[?]\\s*$')} OR {d.rx_has('lower(text)', '^(what|who|when|where|why|how|which|can|is|are)\\b')}) AS question FROM {d.table('conversations')}"


@sql
def is_overview(d):
    # The stems that an overview question may hold.
    stems = ["what", "about", "this", "the", "is", "it", "please", "tell", "me", "give", "summar", "overview", "tl", "dr", "can", "you"]
    word = " OR ".join(d.starts("w", f"'{s}'") for s in stems)
    q = "concat(CASE WHEN conv_id % 2 = 0 THEN 'please summarize this' ELSE concat('overview of ', text) END, '')"
    return f"SELECT conv_id, turn, ({d.rx_has(q, 'summar|overview')} AND {d.all_of(d.rx_all('lower(' + q + ')', '[a-z]+'), 'w', word)}) AS overview FROM {d.table('conversations')}"


@sql
def result_query(d):
    return f"""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {d.table('documents')})
SELECT source, {d.ordered("concat(chr(34), CAST(doc_id AS STRING), chr(34))", 'doc_id', ' OR ')} AS query FROM n WHERE k <= 10 GROUP BY source"""
