"""Passages that questions can be made of (inventory E10): the windows of each text with the most facts, some way apart.

Windows of WIDTH characters begin every STEP characters. A window's score is the number of its signals (each pattern by its weight) over the root of its length; one that is short, has few letters or
few blanks, or a word as long as a dump of data has none. The best windows are taken, later ones first where scores are equal, unless they begin within two widths of one that is taken already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import read, spread
from tessera.registry import frame

WIDTH, STEP, PICKS = 420, 210, 2
#: Windows that are cut out of one stretch of a text: a stretch is found from the text's start, a window from the stretch's.
STRETCH = 256
#: Fixed values of the rule: least length, least share of letters, longest word, characters a blank.
LEAST, LETTERS, LONGEST, BLANKS = 120, 0.35, 60, 25
SIGNALS = (("[0-9]+", 2.0), ("[A-Z][a-z]+", 1.0))


def facts(text: Column) -> Column:
    """The score of a window."""
    n = F.length(text)
    signals = sum((F.regexp_count(text, F.lit(p)) * w for p, w in SIGNALS), F.lit(0.0))
    bad = (n < LEAST) | (F.regexp_count(text, F.lit(r"\p{L}")) < n * LETTERS) | text.rlike(rf"\S{{{LONGEST + 1}}}") | (F.regexp_count(text, F.lit(" ")) < n / BLANKS)
    return F.when(bad, 0.0).otherwise(F.round(signals / F.sqrt(n), 6))


def windows(text: Column, width: int = WIDTH, step: int = STEP) -> Column:
    """Structs (start, score) of the windows of a text that score."""
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - width) / step)).cast("int")
    stretches = F.sequence(F.lit(0), F.floor((count - 1) / STRETCH).cast("int"))

    def of(p: Column) -> Column:
        own = F.substring(text, p * (STRETCH * step) + 1, F.lit(STRETCH * step + width))
        last = F.least(count - p * STRETCH, F.lit(STRETCH)) - 1
        cut = lambda s: F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(((p * STRETCH + k) * step).cast("long").alias("start"), facts(F.substring(s, k * step + 1, F.lit(width))).alias("score")))
        return F.flatten(F.transform(F.array(own), cut))

    return F.filter(F.flatten(F.transform(stretches, of)), lambda x: x["score"] > 0)


def picked(docs: DataFrame, picks: int = PICKS, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """doc_id, nth, start, score, passage (white space folded) of docs (doc_id, text), at most picks of each; a null text has none."""
    best_first = F.reverse(F.array_sort(F.transform("w", lambda x: F.struct(x["score"], x["start"]))))
    none = F.array().cast("array<struct<score:double,start:bigint>>")
    far = lambda kept, x: F.forall(kept, lambda y: F.abs(y["start"] - x["start"]) >= 2 * width)
    taken = F.aggregate(best_first, none, lambda kept, x: F.when((F.size(kept) < picks) & far(kept, x), F.array_append(kept, x)).otherwise(kept))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text", windows(F.col("text"), width, step).alias("w")).select("doc_id", "text", F.posexplode(taken).alias("at", "p"))
    passage = F.trim(F.regexp_replace(F.substring(F.col("text"), (F.col("p.start") + 1).cast("int"), F.lit(width)), r"\s+", " "))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("nth"), "p.start", "p.score", passage.alias("passage"))


@frame(
    r"""WITH x AS (SELECT doc_id, text, unnest(generate_series(0, greatest(1, ceil((length(text) - 420) / 210.0))::BIGINT - 1)) * 210 AS start FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, start, substr(text, start + 1, 420) AS p FROM x),
s AS (SELECT doc_id, start, p, CASE WHEN length(p) < 120 OR len(regexp_extract_all(p, '\p{L}')) < length(p) * 0.35 OR regexp_matches(p, '\S{61}') OR len(regexp_extract_all(p, ' ')) < length(p) / 25.0 THEN 0
 ELSE round((2 * len(regexp_extract_all(p, '[0-9]+')) + len(regexp_extract_all(p, '[A-Z][a-z]+'))) / sqrt(length(p)), 6) END AS score FROM p),
one AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start DESC) = 1),
two AS (SELECT s.* FROM s JOIN one USING (doc_id) WHERE s.score > 0 AND abs(s.start - one.start) >= 840 QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.start DESC) = 1)
SELECT doc_id, nth::BIGINT AS nth, start, score, md5(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS passage_md5 FROM (SELECT *, 1 AS nth FROM one UNION ALL SELECT *, 2 FROM two)"""
)
def passage_pick(spark, d):
    """The two best passages of each document."""
    return picked(spread(read(spark, d, "documents")).select("doc_id", "text")).select("doc_id", "nth", "start", "score", F.md5("passage").alias("passage_md5"))
