"""Copies and versions of documents by shared body keys (inventory F13, P14): a set-similarity join.

A document's keys are the hashes of its lines without white space, of those that are long enough. Another document is a copy if the texts are equal, and a version if it
holds at least RATIO of the document's keys. Equal texts are one, and texts that share the same keys with others are one class, whatever else they hold: a line that thousands
of documents have makes one class of all that share nothing but it. Classes meet on keys. A class asks with its rarest keys alone, all but the last m - 1 if m must be shared: who
shares m keys shares one of these. So documents of which a frequent line is less than RATIO never ask. Pairs of classes are verified by their whole sets; documents get sums over classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import read, shared_path, spread
from tessera.registry import frame

RATIO, LEAST_CHARS = 0.2, 40


def body_keys(text: Column, least: int = LEAST_CHARS) -> Column:
    """The distinct keys of a text's lines."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.array_distinct(F.transform(F.filter(bare, lambda x: F.length(x) >= least), F.md5))


def _stored(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def classes(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_CHARS) -> DataFrame:
    """text_id (smallest doc_id of a text), n (documents of it), n_keys, m (keys that a version must share), class_id, keys (shared with other texts, rarest first)."""
    own = docs.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"), body_keys(F.col("text"), least).alias("k"))
    texts = _stored(own.groupBy("h").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k")))
    each = texts.select("text_id", F.explode("k").alias("key"))
    df = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(df, "key").groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s")).select("text_id", F.transform("s", lambda x: x["key"]).alias("keys"))
    rows = texts.select("text_id", "n", F.size("k").alias("n_keys"), F.ceil(F.size("k") * ratio - 1e-9).cast("int").alias("m")).join(shared, "text_id", "left")
    rows = rows.withColumn("set", F.md5(F.array_join("keys", ",")))
    named = rows.where("keys IS NOT NULL").groupBy("set").agg(F.min("text_id").alias("class_id"))
    return _stored(rows.join(named, "set", "left").select("text_id", "n", "n_keys", "m", F.coalesce("class_id", "text_id").alias("class_id"), "keys"))


def class_pairs(members: DataFrame) -> DataFrame:
    """a, b, shared: classes that share as many keys as some text of a must share."""
    own = members.where("keys IS NOT NULL").groupBy("class_id").agg(F.first("keys").alias("keys"), F.min("m").alias("least"))
    held = own.select(F.col("class_id").alias("b"), F.explode("keys").alias("key"))
    rarest = F.slice("keys", 1, F.greatest(F.size("keys") - F.col("least") + 1, F.lit(0)))
    met = own.where("size(keys) >= least").select(F.col("class_id").alias("a"), F.explode(rarest).alias("key")).join(held, "key").where("a <> b").select("a", "b").distinct()
    of = lambda x: own.select(F.col("class_id").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("least").alias(f"least_{x}"))
    verified = met.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("keys_a", "keys_b")).cast("long"))
    return verified.where("shared >= least_a").select("a", "b", "shared")


def versions(docs: DataFrame, ratio: float = RATIO, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_id, class_id, n_keys, n_copies, n_versions of every document. A null text has neither."""
    members = classes(docs, ratio, least)
    weight = members.groupBy("class_id").agg(F.sum("n").alias("docs"), F.first("keys").alias("keys"))
    asked = members.where("keys IS NOT NULL").select("class_id", "m").distinct()
    pairs = class_pairs(members).join(weight.select(F.col("class_id").alias("b"), "docs"), "b")
    others = asked.join(pairs, F.col("class_id") == F.col("a")).where("shared >= m").groupBy("class_id", "m").agg(F.sum("docs").alias("others"))
    same = weight.select("class_id", F.col("docs").alias("of_class"), F.size("keys").alias("n_shared"))
    texts = members.join(same, "class_id").join(others, ["class_id", "m"], "left")
    alike = F.when(F.col("keys").isNotNull() & (F.col("n_shared") >= F.col("m")), F.col("of_class") - F.col("n")).otherwise(0)
    told = texts.select("text_id", "class_id", "n", "n_keys", (F.coalesce("others", F.lit(0)) + alike).cast("long").alias("n_versions"))
    of = docs.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("h"))
    ids = of.join(of.groupBy("h").agg(F.min("doc_id").alias("text_id")), "h").select("doc_id", "text_id").join(told, "text_id")
    full = ids.select("doc_id", "text_id", "class_id", F.col("n_keys").cast("long").alias("n_keys"), (F.col("n") - 1).alias("n_copies"), "n_versions")
    none = docs.where("text IS NULL").select("doc_id", F.lit(None).cast("long").alias("text_id"), F.lit(None).cast("long").alias("class_id"), *(F.lit(0).cast("long").alias(x) for x in ("n_keys", "n_copies", "n_versions")))
    return full.unionByName(none)


@frame(
    r"""WITH x AS (SELECT doc_id, md5(text) AS h, list_distinct(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\s+', '', 'g')), lambda l: length(l) >= 40), lambda l: md5(l))) AS k FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, h, unnest(k) AS key FROM x), p AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS shared FROM e a JOIN e b ON a.key = b.key AND a.h <> b.h GROUP BY ALL),
v AS (SELECT p.doc_id, count(*) AS n FROM p JOIN x ON x.doc_id = p.doc_id WHERE shared >= 0.2 * len(k) GROUP BY p.doc_id),
t AS (SELECT h, min(doc_id) AS text_id, count(*) AS n FROM x GROUP BY h), often AS (SELECT key FROM (SELECT DISTINCT h, key FROM e) GROUP BY key HAVING count(*) > 1),
s AS (SELECT doc_id, string_agg(key, ',' ORDER BY key) AS own FROM e WHERE key IN (SELECT key FROM often) GROUP BY doc_id), c AS (SELECT own, min(doc_id) AS class_id FROM s GROUP BY own)
SELECT x.doc_id, t.text_id, coalesce(c.class_id, t.text_id) AS class_id, len(k)::BIGINT AS n_keys, t.n - 1 AS n_copies, coalesce(v.n, 0)::BIGINT AS n_versions
FROM x JOIN t ON t.h = x.h LEFT JOIN v ON v.doc_id = x.doc_id LEFT JOIN s ON s.doc_id = x.doc_id LEFT JOIN c ON c.own = s.own
UNION ALL SELECT doc_id, NULL, NULL, 0, 0, 0 FROM documents WHERE text IS NULL"""
)
def doc_versions(spark, d):
    """How many copies and versions each document has among all, and the classes of its text and of its shared lines."""
    return versions(spread(read(spark, d, "documents")).select("doc_id", "text"))
