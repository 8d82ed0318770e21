"""Retrieval quality (inventory E)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.operators.retrieval import BM25_SQL, FIRST_K, bm25_topk, bounded, kept, read, spread, words
from tessera.plans.dialect import DUCK
from tessera.registry import frame, sql
from pyspark.sql import functions as F


@frame(f"WITH {BM25_SQL}, j AS (SELECT query_id, chunk_id, rank, contains(d.text, b.text) AS good FROM bmtop JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id), f AS (SELECT query_id, min(CASE WHEN good THEN rank END) AS r FROM j GROUP BY query_id) SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3 FROM f")
def recall_at_k(spark, d):
    r = first_good(spark, d)
    share = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return r.agg(F.count(F.lit(1)).alias("n"), share(1).alias("recall_1"), share(3).alias("recall_3"))


@frame(f"WITH {BM25_SQL}, j AS (SELECT query_id, chunk_id, rank, contains(d.text, b.text) AS good FROM bmtop JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id), f AS (SELECT query_id, min(CASE WHEN good THEN rank END) AS r FROM j GROUP BY query_id) SELECT count(*) AS n, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr_10 FROM f")
def mrr(spark, d):
    return first_good(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr_10"))


def first_good(spark, d):
    """The first rank whose document holds the item's passage."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    ranked = bounded(bm25_topk(spark, d), FIRST_K * items.count())  # texts stay where they are read
    found = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").join(ranked, "chunk_id").join(items, "query_id")
    return found.groupBy("query_id").agg(F.min(F.when(F.contains("text", "passage"), F.col("rank"))).alias("r"))


@sql
def eval_by_category(d):
    return f"""SELECT x.lang, x.source, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS quality, round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic FROM {d.table('labels')} l JOIN {d.table('documents')} x ON x.doc_id = l.doc_id GROUP BY ROLLUP(x.lang, x.source)"""


@sql
def mcnemar_counts(d):
    return f"WITH r AS (SELECT doc_id, quality AS a, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS b FROM {d.table('labels')}) SELECT {d.at_least_count('a = 1 AND b = 0')} AS a_only, {d.at_least_count('a = 0 AND b = 1')} AS b_only, count(*) AS n FROM r"


@sql
def mcnemar(d):
    """Two-sided exact binomial test on the pairs that two runs decide differently."""
    fact = lambda n: f"lgamma({n} + 1)"
    if d.name == "spark":
        fact = lambda n: f"aggregate(sequence(0, CAST({n} AS INT)), CAST(0 AS DOUBLE), (s, x) -> s + CASE WHEN x > 0 THEN ln(x) ELSE 0 END)"
    return f"""WITH r AS (SELECT doc_id % 10 AS fold, quality AS a, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS b FROM {d.table('labels')}),
c AS (SELECT fold, {d.at_least_count('a = 1 AND b = 0')} AS x, {d.at_least_count('a = 0 AND b = 1')} AS y FROM r GROUP BY fold), m AS (SELECT fold, x, y, x + y AS n, least(x, y) AS k FROM c),
t AS (SELECT fold, x, y, n, {d.each(d.sequence('0', 'CAST(k AS INT)'), 'i')} FROM m)
SELECT fold, x, y, round(least(1.0, 2 * sum(exp({fact('n')} - {fact('i')} - {fact('(n - i)')} - n * ln(2.0)))), 6) AS p FROM t GROUP BY fold, x, y, n"""


def _gram_coverage(d) -> str:
    grams = lambda c: d.distinct(d.map(d.sequence("1", f"greatest({d.size('w')} - 7, 1)"), "k", d.join(d.slice('w', 'CAST(k AS INT)', 8), ' ')))
    return f"""WITH b AS (SELECT item_id, {d.words('text')} AS w FROM {d.table('benchmark')}), g AS (SELECT item_id, {d.each(grams('w'), 'g')} FROM b), x AS (SELECT {d.words('text')} AS w FROM {d.table('documents')}), h AS (SELECT {d.each(grams('w'), 'g')} FROM x), u AS (SELECT DISTINCT g FROM h)
SELECT item_id, count(*) AS n, round(CAST({d.at_least_count('u.g IS NOT NULL')} AS DOUBLE) / count(*), 6) AS coverage FROM g LEFT JOIN u ON u.g = g.g GROUP BY item_id"""


@frame(_gram_coverage(DUCK))
def gram_coverage(spark, d):
    """Share of an item's 8-word groups that any document holds; groups that no item has go where they are read."""

    def grams(texts):
        w = texts.withColumn("w", words(F.col("text"))).where("w IS NOT NULL")
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1)))
        return w.withColumn("g", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("w", k, F.lit(8)), " ")))).drop("w", "text")

    asked = kept(grams(read(spark, d, "benchmark").select("item_id", "text")).distinct())
    keys = asked.select("g").distinct()
    held = grams(spread(read(spark, d, "documents").select("text"))).join(bounded(keys, asked.count()), "g", "left_semi").distinct()
    found = asked.join(held.withColumn("there", F.lit(1)), "g", "left")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.count("there") / F.count(F.lit(1)), 6).alias("coverage"))


@frame("""WITH b AS (SELECT item_id, text, CASE WHEN length(text) < 30 THEN text ELSE substring(text, CAST(floor(length(text) / 2.0) AS INT) - 14, 30) END AS middle FROM benchmark)
SELECT b.item_id, count(*) FILTER (contains(x.text, b.text)) AS whole, count(*) FILTER (contains(x.text, b.middle)) AS middle FROM b LEFT JOIN documents x ON contains(x.text, b.middle) GROUP BY b.item_id""")
def ctx_hit(spark, d):
    """Documents that hold an item in full, and its middle thirty characters (all of an item shorter than that); every item has a row.

    Candidates come from all documents, by a hashed window of bytes of the middle, and are verified by containment.
    """
    text = F.col("text")
    n = F.length(text)
    middle = F.when(n < 30, text).otherwise(F.substring(text, F.floor(n / 2).cast("int") - 14, F.lit(30)))
    items = read(spark, d, "benchmark").select("item_id", text.cast("binary").alias("whole"), middle.cast("binary").alias("middle"))
    wanted = items.where("middle IS NOT NULL").toArrow()  # the items are the small side
    ids, whole, middle = (wanted.column(c).to_pylist() for c in ("item_id", "whole", "middle"))
    hits = read(spark, d, "documents").where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text")).mapInArrow(held(ids, whole, middle), "item_id long, whole long, middle long")
    counts = hits.groupBy("item_id").agg(F.sum("whole").alias("whole"), F.sum("middle").alias("middle"))
    at = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return items.select("item_id").distinct().join(counts, "item_id", "left").select("item_id", at("whole"), at("middle"))


#: Bytes of text searched at once.
BLOCK = 1 << 20


def windows(data: bytes, width: int) -> np.ndarray:
    """A hash of the width (8 or 24) bytes from every place of data on."""
    n = len(data) - 7
    w = np.empty(max(n, 0), np.uint64)
    for s in range(min(8, max(n, 0))):
        w[s::8] = np.frombuffer(data, "<u8", (len(data) - s) // 8, s)
    if width == 24:
        w = w[:-16] + w[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F) + w[16:] * np.uint64(0x165667B19E3779F9) if n > 16 else w[:0]
    return w * np.uint64(0x9E3779B97F4A7C15)


def held(ids: list, whole: list[bytes], middle: list[bytes]):
    """Batches of texts to item_id and the numbers of texts that hold the item's whole and middle."""
    tables, any_text = [], [k for k, m in enumerate(middle) if len(m) < 8]
    for width, own in ((24, [k for k, m in enumerate(middle) if len(m) >= 24]), (8, [k for k, m in enumerate(middle) if 8 <= len(m) < 24])):
        if own:
            keys = np.concatenate([windows(middle[k][:width], width) for k in own])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            tables.append((width, keys[order], np.array(own)[order], seen))

    def candidates(block: list[bytes]) -> set[tuple[int, int]]:
        data = b"".join(block)
        ends = np.cumsum([len(x) for x in block])
        out = {(k, t) for k in any_text for t in range(len(block))}
        for width, keys, own, seen in tables:
            w = windows(data, width)
            at = np.flatnonzero(seen[w >> np.uint64(44)])
            first, last = np.searchsorted(keys, w[at], "left"), np.searchsorted(keys, w[at], "right")
            for p, a, b in zip(at[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
                t = int(np.searchsorted(ends, p, "right"))
                out.update((int(k), t) for k in own[a:b])
        return out

    def run(batches):
        for batch in batches:
            found, block, size = {}, [], 0
            texts = batch.column(0).to_pylist()
            for i, text in enumerate(texts):
                block.append(text)
                size += len(text)
                if size >= BLOCK or i + 1 == len(texts):
                    for k, t in candidates(block):
                        if middle[k] in block[t]:
                            n = found.setdefault(k, [0, 0])
                            n[0] += whole[k] in block[t]
                            n[1] += 1
                    block, size = [], 0
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([ids[k] for k in found], pa.int64()), "whole": pa.array([n[0] for n in found.values()], pa.int64()), "middle": pa.array([n[1] for n in found.values()], pa.int64())})

    return run


@sql
def must_check(d):
    return f"SELECT item_id, {d.all_of(d.slice(d.words('text'), 1, 3), 'w', 'contains(text, w)')} AS must, {d.some_of(d.words('text'), 'w', chr(119) + ' = ' + chr(39) + 'zzz' + chr(39))} AS must_not FROM {d.table('benchmark')}"


@sql
def latency_summary(d):
    q = "percentile(value, {})" if d.name == "spark" else "quantile_cont(value, {})"
    return f"SELECT event_type, count(*) AS n, round({q.format(0.5)}, 6) AS median, round({q.format(0.9)}, 6) AS p90 FROM {d.table('events')} GROUP BY event_type"


@sql
def exact_dups(d):
    return f"""WITH k AS (SELECT doc_id, md5({d.rx_sub('text', chr(92) + 's+', '')}) AS h, source FROM {d.table('documents')}), r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY length(source) DESC, doc_id) AS k, count(*) OVER (PARTITION BY h) AS n FROM k)
SELECT h, doc_id AS keeper, n FROM r WHERE k = 1 AND n > 1"""


@sql
def passage_scores(d):
    """Windows of 420 characters, 210 apart: digits for each root of the length."""
    return f"""WITH w AS (SELECT doc_id, text, {d.each(d.sequence('0', 'greatest(length(text) - 210, 0)', '210'), 'pos0')} FROM {d.table('documents')} WHERE length(text) > 0), p AS (SELECT doc_id, pos0, substring(text, CAST(pos0 AS INT) + 1, 420) AS p FROM w)
SELECT doc_id, CAST(pos0 AS BIGINT) AS start, round({d.size(d.rx_all('p', '[0-9]'))} / sqrt(length(p)), 6) AS score FROM p"""


@sql
def allocate(d):
    """Two for each folder and a rounded share of the rest, half to even."""
    even = "bround(100.0D * n / t, 0)" if d.name == "spark" else "round_even(100.0::DOUBLE * n / t, 0)"
    return f"WITH g AS (SELECT source, count(*) AS n FROM {d.table('documents')} GROUP BY source), s AS (SELECT source, n, sum(n) OVER () AS t FROM g) SELECT source, n, CAST(2 + {even} AS BIGINT) AS share FROM s"


@sql
def mine_facts(d):
    return f"WITH f AS (SELECT doc_id, {d.each(d.rx_all('text', '[A-Za-z]+ [0-9]{2,}'), 'fact')} FROM {d.table('documents')}) SELECT doc_id, fact, count(*) AS n FROM f GROUP BY doc_id, fact"


@sql
def run_diff(d):
    t = d.table("labels")
    return f"WITH a AS (SELECT doc_id, quality FROM {t} WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality FROM {t} WHERE doc_id % 6 <> 0) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'gone' WHEN b.quality > a.quality THEN 'win' ELSE 'lose' END AS change FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.quality <> b.quality"
