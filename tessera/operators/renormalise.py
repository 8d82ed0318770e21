"""Normalised metadata that follows its rules (inventory M19): a change of raw values or of rules computes anew the rows that it reaches, and no others.

Rules are rows (kind, key, value, points). `type`: a word of a title scores points for a type of document. `alias`: a name goes by another one. A row of metadata carries the hash of
its raw values and that of the rules that met it. What two versions of the rules do not share is few rows; their keys go to the raw values, which are scanned in place, and tell the
documents that they reach: those that hold such a word or name, whether the rule came, went or changed. No table of all words and rules is joined for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.registry import frame

META = ["doc", "raw_hash", "rules_hash", "doc_type", "points"]
#: Changed rules up to this number are broadcast to the raw values, more are joined by shuffle.
FEW_RULES = 100_000


def words_of(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[ \t\n\x0b\f\r]+"), lambda w: w != ""))


def names_of(people: Column) -> Column:
    """Names in lower case without what stands in brackets or from a sign @ on; empty ones left out."""
    bare = lambda p: F.btrim(F.regexp_replace(F.regexp_replace(F.lower(p), "@.*$", ""), r"\s*\([^)]*\)\s*", " "), F.lit(" "))
    return F.array_distinct(F.filter(F.transform(F.coalesce(people, F.array().cast("array<string>")), bare), lambda p: p.isNotNull() & (p != "")))


def _keys(raw: DataFrame) -> DataFrame:
    """doc, kind, key: all that a rule can meet."""
    each = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    return raw.select("doc", F.explode(F.concat(each("type", words_of(F.col("title"))), each("alias", names_of(F.col("people"))))).alias("k")).select("doc", "k.kind", "k.key")


def _hash(rule_rows: bool) -> Column:
    return F.xxhash64("kind", "key", "value", "points") if rule_rows else F.xxhash64(F.lit("raw"), "title", F.coalesce("people", F.array()))


def one_each(raw: DataFrame) -> DataFrame:
    """Raw rows (doc, title, people) with one row a document, the greatest of those that repeat; a null doc goes."""
    return raw.where("doc IS NOT NULL").groupBy("doc").agg(F.max(F.struct("title", "people")).alias("one")).select("doc", "one.title", "one.people")


def normalised(raw: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of META, and (doc, person), of raw rows. Of types with equal points the first by name; of several aliases of a name the first. Repeated rules count once."""
    met = _keys(raw).join(rules.distinct(), ["kind", "key"])
    hashes = met.groupBy("doc").agg(F.bit_xor(_hash(True)).alias("rules_hash"))
    scores = met.where("kind = 'type'").groupBy("doc", "value").agg(F.sum("points").alias("points"))
    best = scores.groupBy("doc").agg(F.min_by(F.struct(F.col("value").alias("doc_type"), "points"), F.struct(-F.col("points"), F.col("value"))).alias("best"))
    meta = raw.select("doc", _hash(False).alias("raw_hash")).join(hashes, "doc", "left").join(best, "doc", "left")
    alias = rules.where("kind = 'alias'").groupBy("key").agg(F.min("value").alias("value"))
    people = raw.select("doc", F.explode(names_of(F.col("people"))).alias("key")).join(alias, "key", "left").select("doc", F.coalesce("value", "key").alias("person")).distinct()
    return meta.select("doc", "raw_hash", F.coalesce("rules_hash", F.lit(0).cast("long")).alias("rules_hash"), "best.doc_type", "best.points"), people


def reached(raw: DataFrame, meta: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """doc of the raw rows to compute: new ones, ones of other raw values, and ones that hold the key of a rule that only one version of the rules has."""
    was, now = old.distinct(), new.distinct()
    changed = was.exceptAll(now).unionByName(now.exceptAll(was)).select("kind", "key").distinct()
    few = changed.limit(FEW_RULES + 1).count() <= FEW_RULES
    by_rule = _keys(raw).join(F.broadcast(changed) if few else changed, ["kind", "key"], "left_semi").select("doc")
    held = meta.select("doc", F.col("raw_hash").alias("held"))
    by_raw = raw.select("doc", _hash(False).alias("raw_hash")).join(held, "doc", "left").where(~F.col("raw_hash").eqNullSafe(F.col("held"))).select("doc")
    return by_rule.unionByName(by_raw).distinct()


def renormalised_tables(raw: DataFrame, meta: DataFrame, people: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, people, doc computed): the stored tables brought in line with raw rows and the new rules, which is what normalised() gives for all rows. Documents without raw values go."""
    todo = reached(raw, meta, old, new)
    fresh_meta, fresh_people = normalised(raw.join(todo, "doc", "left_semi"), new)
    stay = lambda rows: rows.join(todo, "doc", "left_anti").join(raw.select("doc"), "doc", "left_semi")
    return stay(meta).select(*META).unionByName(fresh_meta), stay(people).select("doc", "person").unionByName(fresh_people), todo


def _raw(spark, d: str, edited: bool) -> DataFrame:
    """Documents: the first line as title, a person by doc_id and one by source; an edited one has its number at the end of the title."""
    k, line = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n")[0]
    title = F.when(k % 7 == 0, F.concat(line, F.lit(" no"), k.cast("string"))).otherwise(line) if edited else line
    docs = spark.read.parquet(f"{d}/documents.parquet").where(k % 10 != (2 if edited else 1))
    return docs.select(k.alias("doc"), title.alias("title"), F.array(F.concat(F.lit("P"), (k % 50).cast("string"), F.lit(" (team)")), F.concat("source", F.lit("@x.org"))).alias("people"))


def _rules(spark, d: str, new: bool) -> DataFrame:
    """Words of titles of 4 and 8 letters as types, of three letters too in the new version, where one beginning counts more; two aliases, of which one is new."""
    words = _raw(spark, d, False).unionByName(_raw(spark, d, True)).select(F.explode(words_of(F.col("title"))).alias("key")).distinct()
    n, more = F.length("key"), F.col("key").startswith("th")
    types = words.where(n.isin(4, 8) | (F.lit(new) & (n == 3) & F.col("key").startswith("d")))
    types = types.select(F.lit("type").alias("kind"), "key", F.concat(F.lit("t"), (n % 3).cast("string")).alias("value"), F.when(F.lit(new) & more, 3).otherwise(1).cast("long").alias("points"))
    known = [("alias", "p7", "seven", 0)] + ([("alias", "src3", "p3", 0)] if new else [])
    return types.unionByName(spark.createDataFrame(known, "kind string, key string, value string, points long"))


@frame(
    """WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS was, source FROM documents),
b AS (SELECT doc_id, was, source, CASE WHEN doc_id % 7 = 0 THEN concat(was, ' no', doc_id) ELSE was END AS title FROM a),
w AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(title), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS k FROM b WHERE doc_id % 10 <> 2),
old AS (SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(lower(was), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS k FROM b),
m AS (SELECT doc_id, concat('t', length(k) % 3) AS kind, CASE WHEN starts_with(k, 'th') THEN 3 ELSE 1 END AS p FROM w WHERE length(k) IN (4, 8) OR (length(k) = 3 AND starts_with(k, 'd'))),
s AS (SELECT doc_id, kind, CAST(sum(p) AS BIGINT) AS points FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, kind) AS place FROM s),
p AS (SELECT DISTINCT doc_id, unnest([CASE doc_id % 50 WHEN 7 THEN 'seven' ELSE concat('p', doc_id % 50) END, CASE source WHEN 'src3' THEN 'p3' ELSE source END]) AS person FROM b),
n AS (SELECT doc_id, string_agg(person, ',' ORDER BY person) AS people FROM p GROUP BY doc_id),
t AS (SELECT DISTINCT doc_id FROM w WHERE (length(k) = 3 AND starts_with(k, 'd')) OR (length(k) IN (4, 8) AND starts_with(k, 'th')))
SELECT b.doc_id AS doc, r.kind AS doc_type, r.points, n.people, b.doc_id % 10 = 1 OR b.doc_id % 7 = 0 OR source = 'src3' OR t.doc_id IS NOT NULL AS computed
FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.place = 1 JOIN n ON n.doc_id = b.doc_id LEFT JOIN t ON t.doc_id = b.doc_id WHERE b.doc_id % 10 <> 2"""
)
def renormalised(spark, d):
    """Documents' metadata of yesterday and its rules, brought in line with today's: doc, doc_type, points, people, and whether it was computed anew."""
    old, new = _rules(spark, d, False), _rules(spark, d, True)
    meta, people = normalised(_raw(spark, d, False), old)
    meta, people, todo = renormalised_tables(_raw(spark, d, True), meta, people, old, new)
    who = people.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("person")), ",").alias("people"))
    return meta.join(who, "doc", "left").join(todo.withColumn("computed", F.lit(True)), "doc", "left").select("doc", "doc_type", "points", "people", F.coalesce("computed", F.lit(False)).alias("computed"))
