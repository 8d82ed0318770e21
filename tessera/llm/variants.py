"""Spelling variants by anagram hashing.

A word's anagram key is the sum of a power of each letter (its code point to the fifth, modulo a prime of 61 bits, so that no word is too long). One added letter
adds its power to the key, a removed one takes it off, a replaced one does both. So every word gives its key and, for each of its distinct letters, the key without
it: a key that meets a key less one letter differs by an addition, two keys less one letter that meet differ by an exchange. Pairs of unequal keys that meet are
verified in letter order, by an edit distance of one. Anagrams have equal keys and are never near, so they are not paired. All of it is equal joins of bounded rows: a
word gives at most one row a letter of the alphabet.

A form is the near word of largest count, if that is big enough; roots follow forms. Each step multiplies the count, so paths are short; they are
halved in rounds until none changes.

Nulls: a null text has no words; a null doc_id is written as nothing in front of the colon. Rows that repeat count again. An empty
table gives an empty result. Ties of counts fall to the smaller word by code points. Very long runs are words like any other. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import store

LEAST_LETTERS, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
POWER, PRIME = 5, (1 << 61) - 1
LETTERS = r"[A-Za-zÀ-ÿ]"


def lowered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def typed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, every: int = EVERY) -> DataFrame:
    """word: each run of letters, lower-cased, less a letter where every divides the hash of `doc_id:run`; those of at least letters code points."""
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{LETTERS}{{{letters},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    run = run.select("run", h.alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))
    return run.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)


def power(letter: Column) -> Column:
    """What a letter adds to a key."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code % PRIME


def keyed(words: DataFrame) -> DataFrame:
    """word, n, key, at, less: a word's key (less is false) and its key without each of its letters (true)."""
    letters = F.split("word", "")
    key = F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: (s + power(x)) % PRIME)
    whole = words.select("word", "n", key.alias("key"), F.array_distinct(letters).alias("letters"))
    each = F.concat(F.array(F.struct(F.col("key").alias("at"), F.lit(False).alias("less"))), F.transform("letters", lambda x: F.struct(F.pmod(F.col("key") - power(x), F.lit(PRIME)).alias("at"), F.lit(True).alias("less"))))
    return whole.select("word", "n", "key", F.explode(each).alias("e")).select("word", "n", "key", "e.at", "e.less")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, other, other_n: both ways, all pairs of words (word, n) that one inserted, deleted or replaced code point parts."""
    rows = keyed(words)
    a, b = rows.alias("a"), rows.alias("b")
    # A whole key stands on one side only, and two keys less a letter meet with the smaller word at the left: every pair once.
    meet = (F.col("a.at") == F.col("b.at")) & (F.col("a.key") != F.col("b.key")) & F.col("b.less") & (~F.col("a.less") | (F.col("a.word") < F.col("b.word")))
    met = a.join(b, meet).where(F.levenshtein("a.word", "b.word", 1) == 1)
    pair = F.array(F.struct(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")), F.struct(F.col("b.word").alias("word"), F.col("a.word").alias("other"), F.col("a.n").alias("other_n")))
    return met.select(F.explode(pair).alias("p")).select("p.*")


def roots(forms: DataFrame, n_rounds: int = 64) -> DataFrame:
    """word, root of links (word, form): the last word that forms lead to. Paths are halved in each round."""
    links = store(forms.select("word", F.col("form").alias("root")), "links")
    for _ in range(n_rounds):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = store(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links
    raise ValueError("forms lead in a circle")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least letters code points that stands at least least times."""
    counted = typed(docs, doc_id, text, letters, every).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = store(counted.where(F.col("n") >= least), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", "best.form", (-F.col("best.minus")).alias("form_n"))
    found = words.join(near, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    found = store(found.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")), "variants")
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return variants(docs.select("doc_id", "text"))
