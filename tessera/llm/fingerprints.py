"""I-Match fingerprints. DataFrame operations only.

The lexicon holds the terms whose inverse document frequency ln(N / df), over all documents, lies in a chosen band. It falls into
randomised subsets by a hash of the term: TIERS tiers of SUBSETS disjoint subsets, a subset of tier t taking one term in
RATES[t]. The distinct terms that a document shares with a subset are sorted and hashed together; the fingerprint is the
subsets' hashes in turn, eight hex digits each, dots where the document shares no term.

Likeness of two fingerprints: in each tier the equal subsets as a share of those that either fills; the tier that fits the documents' length best
counts, which is the highest share among tiers with at least LEAST filled subsets (or else all subsets together). 1 for equal fingerprints.

The lexicon is small whatever the corpus: a term in it stands in at least N * exp(-high) documents, so it has at most
exp(high) * (mean distinct terms of a document) terms. It is broadcast if its count is below LEXICON_BOUND, else joined by shuffle.

Documents are dealt once, by ranges of doc_id, and each range also gets the first document of the next: edited texts and next
documents are then at hand, and all later steps keep that partitioning.

Terms are lower-cased words between runs of white space. A document without any term of the band is fingerprinted over one further subset, all its terms.
Nulls: a null text is an empty one; a null doc_id comes after all others. Rows that repeat a doc_id follow each other by text. An empty table gives an
empty result; a single document is its own next one. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LAST_ID, SPACE_CHARS, SPACES, store, text_size

IDF_LOW, IDF_HIGH = 2.5, 7.5
SUBSETS = 16
RATES = (16, 64, 256, 1024)
TIERS = len(RATES)
LEAST = 4
SEED = 97
LEXICON_BOUND = 1_000_000
#: Bytes of text in a range; of a large corpus the ranges grow, not their number (their bounds are in the plan): they are sorted and streamed, and spill.
RANGE_BYTES, MOST_RANGES = 8 << 20, 4096


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    bare = F.lower(F.btrim(text, F.lit(SPACE_CHARS)))
    return F.when(F.length(bare) > 0, F.array_distinct(F.split(bare, SPACES))).otherwise(F.array().cast("array<string>"))


def lexicon(docs: DataFrame, text: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """Hashes (term) of the terms whose IDF lies in the band."""
    total = docs.count()
    held = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).select(F.xxhash64("term").alias("term"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    return df.where(idf.between(low, high)).select("term")


def _range_of(bounds: list[int]):
    """Number of bounds at or below doc_id, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    lists = F.array(*(F.array(*(F.lit(b).cast("long") for b in c)) for c in chunks))
    heads = F.array(*(F.lit(c[0]).cast("long") for c in chunks))
    chunk = F.size(F.filter(heads, lambda b: b <= F.col("doc_id")))
    inside = F.size(F.filter(F.element_at(lists, F.greatest(chunk, F.lit(1))), lambda b: b <= F.col("doc_id")))
    return F.when(chunk > 0, (chunk - 1) * step + inside).otherwise(0)


def in_ranges(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """part, doc_id, text, ghost: documents dealt by ranges of doc_id, each range with the document after its last as a ghost."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, size = text_size(own)
    parts = max(1, min(-(-size // RANGE_BYTES), rows, MOST_RANGES))
    bounds = own.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    dealt = own.withColumn("part", _range_of(sorted(set(bounds or []))))
    # A row a range, MOST_RANGES at most.
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first_id"))
    in_turn = Window.orderBy("part")
    turned = firsts.select(F.col("part").alias("own_part"), "first_id", F.lag("part").over(in_turn).alias("to_part"), F.max("part").over(Window.partitionBy()).alias("last_part"))
    ahead = turned.select("own_part", "first_id", F.coalesce("to_part", "last_part").alias("to_part"))
    known = F.col("part") == F.col("own_part")
    ghosts = dealt.join(F.broadcast(store(ahead, "ranges")), known & (F.col("doc_id") == F.col("first_id")))
    ghosts = ghosts.groupBy("to_part", "doc_id").agg(F.min("text").alias("text")).select(F.col("to_part").alias("part"), "doc_id", "text", F.lit(1).alias("ghost"))
    every = dealt.select("part", "doc_id", "text", F.lit(0).alias("ghost")).unionByName(ghosts)
    return every.repartition(max(1, len(bounds or []) + 1), "part")


def _prints(exploded: DataFrame) -> DataFrame:
    """part, row_no, side, print, info: sorted distinct terms of each subset hashed, and the subsets' hashes in turn.

    exploded: part, row_no, side, term, info; the one row of a side without a term carries info, the rest none.
    """
    h = lambda tier: F.shiftrightunsigned(F.xxhash64("term", F.lit(SEED + tier)), 16)
    # A term lies in one subset of a tier at most: subset = hash modulo the tier's rate, where that is below SUBSETS.
    subsets = F.array(*(F.when(h(t) % RATES[t] < SUBSETS, (h(t) % RATES[t]).cast("int") + F.lit(SUBSETS * t)) for t in range(TIERS)))
    held = F.when(F.col("term").isNotNull(), F.filter(subsets, lambda x: x.isNotNull())).otherwise(F.array(F.lit(-1)))
    rows = exploded.select("part", "row_no", "side", "term", "info", F.explode(held).alias("subset"))
    keys = ["part", "row_no", "side"]
    each = rows.groupBy(*keys, "subset").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.first("info", ignorenulls=True).alias("info"))
    one = each.select(*keys, "subset", "info", F.substring(F.lpad(F.lower(F.hex(F.xxhash64("terms"))), 16, "0"), 1, 8).alias("code"))
    found = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("subset", "code"))).alias("codes"), F.max("subset").alias("top"), F.first("info", ignorenulls=True).alias("info"))
    codes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS * TIERS - 1)), lambda k: F.coalesce(F.col("codes")[k], F.lit("."))), "")
    return found.select(*keys, "info", F.when(F.col("top") >= 0, codes).otherwise(F.concat(F.lit("all:"), F.col("info.whole"))).alias("print"))


def _split(printed: Column) -> Column:
    """The subsets' codes; null where a subset is empty."""
    return F.regexp_extract_all(printed, F.lit(r"\.|[0-9a-f]{8}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Of two columns of codes."""

    def share(x: Column, y: Column, least: int) -> Column:
        pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
        used = F.filter(pairs, lambda p: (p["x"] != ".") | (p["y"] != "."))
        n = F.size(used)
        return F.when(n >= least, F.size(F.filter(used, lambda p: p["x"] == p["y"])) / n)

    tiers = [share(F.slice(a, SUBSETS * t + 1, SUBSETS), F.slice(b, SUBSETS * t + 1, SUBSETS), LEAST) for t in range(TIERS)]
    both = (F.size(a) == SUBSETS * TIERS) & (F.size(b) == SUBSETS * TIERS)
    return F.when(a == b, 1.0).when(both, F.coalesce(F.greatest(*tiers), share(a, b, 1), F.lit(0.0))).otherwise(0.0)


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    band = store(lexicon(docs, text), "lexicon")
    few = band.count() <= LEXICON_BOUND
    rows = in_ranges(docs, doc_id, text)
    turn = Window.partitionBy("part").orderBy("ghost", "doc_id", "text")
    rows = rows.withColumn("row_no", F.row_number().over(turn)).withColumn("next_text", F.lead("text").over(turn))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    rows = rows.select("part", "row_no", "doc_id", "ghost", n.cast("long").alias("n_chars"), "text", F.when(F.col("ghost") == 0, edited).alias("edited"))
    # One pass over both texts. A null term ends each list: its row carries what the result needs besides, the others travel light.
    side = lambda k, text: F.struct(F.lit(k).alias("side"), terms(text).alias("terms"))
    sides = rows.select("*", F.explode(F.array(side(1, F.col("text")), side(2, F.coalesce("edited", F.lit(""))))).alias("own"))
    whole = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(F.sort_array("own.terms")))), 16, "0"), 1, 8)
    info = F.struct("doc_id", "ghost", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), whole.alias("whole"))
    ended = sides.select("part", "row_no", "own.side", info.alias("info"), F.explode(F.concat("own.terms", F.array(F.lit(None).cast("string")))).alias("word"))
    flat = ended.select("part", "row_no", "side", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"), F.when(F.col("word").isNull(), F.col("info")).alias("info"))
    known = band.select(F.col("term").alias("known"))
    marked = flat.join(F.broadcast(known) if few else known, F.col("term") == F.col("known"), "left").where(F.col("known").isNotNull() | F.col("term").isNull())
    prints = _prints(marked.select("part", "row_no", "side", "term", "info"))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    both = prints.groupBy("part", "row_no").agg(of(1, "print").alias("fingerprint"), of(2, "print").alias("edited_fingerprint"), of(1, "info").alias("info"))
    both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("row_no"))).where(F.col("info.ghost") == 0)
    a, b, c = (_split(F.col(x)) for x in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    like = lambda x, y, p, q: F.when(F.col(p) == F.col(q), 1.0).otherwise(F.coalesce(likeness(x, y), F.lit(0.0)))
    return both.select(
        F.when(F.col("info.doc_id") != LAST_ID, F.col("info.doc_id")).alias("doc_id"),
        F.col("info.n_chars").alias("n_chars"),
        F.col("info.edited_sha256").alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        like(a, b, "fingerprint", "edited_fingerprint").alias("near_edited"),
        like(a, c, "fingerprint", "next_fingerprint").alias("near_next"),
    )


def query(docs: DataFrame) -> DataFrame:
    return fingerprinted(docs)
