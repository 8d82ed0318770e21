"""Incremental indexing (inventory I, S25-S30) and of metadata and index (M23): differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import frame, sql


def snapshots(d):
    """Yesterday's state and today's folder, drawn from the documents."""
    t = d.table("documents")
    path = "concat('/corpus/', source, '/', CAST(doc_id AS STRING), '.txt')"
    moved = "CASE WHEN doc_id % 13 = 0 THEN concat('/moved/', CAST(doc_id AS STRING), '.txt') ELSE " + path + " END"
    return f"""old AS (SELECT doc_id, {path} AS path, md5(text) AS h, n_chars FROM {t} WHERE doc_id % 10 <> 1),
new AS (SELECT doc_id, {moved} AS path, CASE WHEN doc_id % 7 = 0 THEN md5(concat(text, '+')) ELSE md5(text) END AS h, n_chars FROM {t} WHERE doc_id % 10 <> 2)"""


@sql
def plan_changes(d):
    return f"""WITH {snapshots(d)} SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed' WHEN n.h <> o.h THEN 'changed' ELSE 'same' END AS op
FROM new n FULL OUTER JOIN old o ON o.path = n.path"""


@sql
def find_removed(d):
    return f"WITH {snapshots(d)} SELECT o.path FROM old o LEFT JOIN new n ON n.path = o.path WHERE n.path IS NULL AND {d.starts('o.path', chr(39) + '/corpus/' + chr(39))}"


@sql
def delete_guard(d):
    return f"""WITH {snapshots(d)}, c AS (SELECT {d.rx_get('o.path', '^/corpus/([^/]+)/', 1)} AS root, count(*) AS had, {d.at_least_count('n.path IS NULL')} AS gone FROM old o LEFT JOIN new n ON n.path = o.path GROUP BY 1)
SELECT root, had, gone, (gone >= 50 OR (gone >= 5 AND gone >= 0.3 * had)) AS blocked FROM c"""


@sql
def find_moves(d):
    """Removed and new files of equal content pair off one to one, in path order."""
    return f"""WITH {snapshots(d)}, r AS (SELECT o.path, o.h, row_number() OVER (PARTITION BY o.h ORDER BY o.path) AS k FROM old o LEFT JOIN new n ON n.path = o.path WHERE n.path IS NULL),
a AS (SELECT n.path, n.h, row_number() OVER (PARTITION BY n.h ORDER BY n.path) AS k FROM new n LEFT JOIN old o ON n.path = o.path WHERE o.path IS NULL)
SELECT r.path AS from_path, a.path AS to_path FROM r JOIN a ON a.h = r.h AND a.k = r.k"""


@sql
def copied_from(d):
    return f"""WITH {snapshots(d)}, a AS (SELECT n.path, n.h FROM new n LEFT JOIN old o ON n.path = o.path WHERE o.path IS NULL),
s AS (SELECT o.h, min(o.path) AS path FROM old o JOIN new n ON n.path = o.path GROUP BY o.h)
SELECT a.path AS path, s.path AS copied_from FROM a JOIN s ON s.h = a.h"""


@sql
def classify_ops(d):
    return f"""WITH {snapshots(d)}, x AS (SELECT n.path, n.h, o.path AS old_path, o.h AS old_h FROM new n LEFT JOIN old o ON n.path = o.path), s AS (SELECT h, min(path) AS any_path FROM old GROUP BY h)
SELECT x.path, CASE WHEN old_path IS NOT NULL AND x.h = old_h THEN 'same' WHEN old_path IS NOT NULL THEN 'modified' WHEN s.any_path IS NOT NULL THEN 'copied' ELSE 'added' END AS op FROM x LEFT JOIN s ON s.h = x.h"""


@sql
def alloc_ids(d):
    """Contiguous ids: sums inside a source, then of the sources before it, so that no single task orders every document."""
    t = d.table("documents")
    return f"""WITH s AS (SELECT source, sum(n_chars) AS n FROM {t} GROUP BY source), b AS (SELECT source, sum(n) OVER (ORDER BY source) - n AS base FROM s)
SELECT x.doc_id, CAST(base + sum(x.n_chars) OVER (PARTITION BY x.source ORDER BY x.doc_id) - x.n_chars AS BIGINT) AS id_from, CAST(x.n_chars AS BIGINT) AS n FROM {t} x JOIN b ON b.source = x.source"""


@sql
def defer_vectors(d):
    t = d.table("documents")
    return f"SELECT doc_id, (sum(CAST(n_chars / 700 AS BIGINT) + 1) OVER (PARTITION BY source ORDER BY doc_id)) > 50 AS deferred FROM {t}" if d.name == "spark" else f"SELECT doc_id, (sum(CAST(floor(n_chars / 700) AS BIGINT) + 1) OVER (PARTITION BY source ORDER BY doc_id)) > 50 AS deferred FROM {t}"


@sql
def orphan_chunks(d):
    return f"""WITH o AS (SELECT e.vec_id, x.doc_id IS NULL AS orphan FROM {d.table('embeddings')} e LEFT JOIN {d.table('documents')} x ON x.doc_id = e.vec_id)
SELECT vec_id FROM o WHERE orphan AND (SELECT avg(CASE WHEN orphan THEN 1.0 ELSE 0.0 END) FROM o) <= 0.7"""


@sql
def max_add_hold(d):
    """Of the added files the first 50 by path go in, the others wait; the 50th path is found by a top-k, so that no task orders all of them."""
    added = f"WITH {snapshots(d)}, a AS (SELECT n.path FROM new n LEFT JOIN old o ON n.path = o.path WHERE o.path IS NULL)"
    if d.name == "duckdb":
        return f"{added}, r AS (SELECT path, row_number() OVER (ORDER BY path) AS k FROM a) SELECT path, k > 50 AS held FROM r"
    return f"{added} SELECT path, path > (SELECT max(path) FROM (SELECT path FROM a ORDER BY path LIMIT 50)) AS held FROM a"


@sql
def outside_docs(d):
    """Documents under none of the roots: an anti join on path prefixes, the roots being few."""
    return f"""WITH {snapshots(d)}, roots AS (SELECT DISTINCT concat('/corpus/', source, '/') AS root FROM {d.table('documents')} WHERE source IN ('src1', 'src2', 'src3'))
SELECT n.path FROM new n WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE {d.starts('n.path', 'r.root')})"""


@sql
def progress_rate(d):
    ts = d.epoch("ts")
    return f"""WITH w AS (SELECT event_id, user_id, {ts} AS secs, count(*) OVER p AS n, min({ts}) OVER p AS since FROM {d.table('events')} WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, n, CASE WHEN secs > since THEN round(CAST(n AS DOUBLE) / CAST(secs - since AS DOUBLE), 6) END AS rate FROM w"""


@sql
def move_docs(d):
    return f"SELECT doc_id, CASE WHEN source = 'src1' THEN concat('/archive/', CAST(doc_id AS STRING)) ELSE concat('/', source, '/', CAST(doc_id AS STRING)) END AS path FROM {d.table('documents')}"


@sql
def delete_doc_except(d):
    return f"SELECT x.doc_id, x.source FROM {d.table('documents')} x WHERE NOT (x.source = 'src2' AND NOT EXISTS (SELECT 1 FROM {d.table('benchmark')} i WHERE i.item_id = x.doc_id))"


@sql
def index_status(d):
    return f"SELECT source, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM {d.table('documents')} GROUP BY source, lang"


@sql
def upsert_latest(d):
    return f"""WITH s AS (SELECT doc_id, 1 AS gen, n_chars FROM {d.table('documents')} UNION ALL SELECT doc_id, 2, n_chars + 1 FROM {d.table('documents')} WHERE doc_id % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gen DESC) AS k FROM s) SELECT doc_id, gen, n_chars FROM r WHERE k = 1"""


@sql
def conv_search(d):
    """Search inside each conversation with that conversation's own statistics."""
    c = d.table("conversations")
    return f"""WITH w AS (SELECT conv_id, turn, {d.words('lower(text)')} AS w FROM {c}), tok AS (SELECT conv_id, turn, {d.size('w')} AS dl, {d.each('w', 'term')} FROM w),
st AS (SELECT conv_id, count(*) AS n, avg({d.size(d.words('text'))}) AS avgdl FROM {c} GROUP BY conv_id),
q AS (SELECT DISTINCT conv_id, term FROM tok WHERE turn = 0), p AS (SELECT conv_id, turn, dl, term, count(*) AS tf FROM tok GROUP BY conv_id, turn, dl, term),
df AS (SELECT conv_id, term, count(*) AS df FROM p GROUP BY conv_id, term),
s AS (SELECT p.conv_id, p.turn, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM p JOIN q ON q.conv_id = p.conv_id AND q.term = p.term JOIN df ON df.conv_id = p.conv_id AND df.term = p.term JOIN st ON st.conv_id = p.conv_id GROUP BY p.conv_id, p.turn),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS place FROM s) SELECT conv_id, turn, score, CAST(place AS BIGINT) AS place FROM r WHERE place <= 3"""


def reconciled(wanted: DataFrame, held: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_path, op: what brings stored metadata in line with an index, in one pass.

    wanted (doc_path, content_hash) are the indexed documents, null hash for those that failed; held (doc_path) has metadata; bodies
    (doc_path, content_hash) have the head of a text. `fill`: wanted and not held. `prune`: held and not wanted. `body`: wanted, of a known
    hash that differs from the body's, or without one. A document may have two of them. Repeated rows count once; of several hashes the greatest.
    """
    w = wanted.where("doc_path IS NOT NULL").groupBy("doc_path").agg(F.max("content_hash").alias("hash"), F.lit(True).alias("is_wanted"))
    h = held.where("doc_path IS NOT NULL").select("doc_path").distinct().withColumn("is_held", F.lit(True))
    b = bodies.groupBy("doc_path").agg(F.max("content_hash").alias("body_hash"))
    both = w.join(h, "doc_path", "full").join(b, "doc_path", "left")
    ops = F.array_compact(
        F.array(
            F.when(F.col("is_held").isNull(), "fill"),
            F.when(F.col("is_wanted").isNull(), "prune"),
            F.when(F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("body_hash")), "body"),
        )
    )
    return both.select("doc_path", F.explode(ops).alias("op"))


@frame(
    """WITH w AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN md5(text) END AS h FROM documents WHERE doc_id % 11 <> 0), h AS (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE md5(text) END AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id AS doc_path, 'fill' AS op FROM (SELECT doc_id FROM w EXCEPT SELECT doc_id FROM h) UNION ALL SELECT doc_id, 'prune' FROM (SELECT doc_id FROM h EXCEPT SELECT doc_id FROM w)
UNION ALL SELECT doc_id, 'body' FROM (SELECT doc_id, h FROM w WHERE h IS NOT NULL EXCEPT SELECT doc_id, h FROM b)"""
)
def reconcile(spark, d):
    """Documents as an index whose metadata and text heads lag behind."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc_path"), F.md5("text").alias("h"))
    k = F.col("doc_path")
    wanted = docs.where(k % 11 != 0).select("doc_path", F.when(k % 13 != 0, F.col("h")).alias("content_hash"))
    bodies = docs.where(k % 5 != 0).select("doc_path", F.when(k % 7 == 0, "old").otherwise(F.col("h")).alias("content_hash"))
    return reconciled(wanted, docs.where(k % 9 != 0), bodies)
