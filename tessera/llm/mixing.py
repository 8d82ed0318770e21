"""Mixing sources to target weights by pivotal dependent rounding. DataFrame operations only.

Each source has a target number of words; a document of it is due target / source size copies, a whole part for certain and
a fraction by chance. The fractions of a source are rounded together: two documents meet, and a random amount of mass (words)
passes from one to the other until one has zero or one copy; its fate is sealed, the other goes on. Every meeting keeps the
source's words, and each document's expected copies, so a source misses its target by less than one document.

Meetings happen in blocks of about BLOCK documents, longest first so that what is left over is short; the one document
that a block leaves undecided goes to the next level of the tree, BLOCK blocks at a time. Levels grow with the logarithm of
the source; a source of a third of all rows is as many blocks as it needs, each bounded.

A unit of rounding is a row, whatever its id: null and repeated doc_ids are documents of their own. Rows that are equal in all columns (but for maps, which have no hash) are
one unit of so many rows, which shares out its copies evenly, so that no one has to number them.

Nulls: a null text has size 0, a document of size 0 is taken 0 times; a null source is a source, the last. An empty table gives an empty result. Very long texts are one
document like others. Other columns pass through mixture() unchanged. Ties do not matter. Random numbers are hashes of rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, n_words, store, uniform

BLOCK = 64
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = 2027


def source_targets(units: DataFrame) -> DataFrame:
    """source, source_size, target, due (copies of each document): targets by weight, none above MOST_COPIES times its source.

    Filled sources are those of the smallest cap by weight: with sources in that order, the level of the first that stays below its
    cap is the level of all after it. One row a source.
    """
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = sums.select("source", "source_size", weight.cast("double").alias("w")).withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = caps.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("filled"),
        F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
    )
    level = (F.col("total") - F.col("filled")) / F.col("open")
    first_open = F.max(F.when(level * F.col("w") <= F.col("cap"), level)).over(everything)
    target = F.least(F.col("cap"), F.coalesce(first_open, F.lit(0.0)) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target")).withColumn("due", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0))


def _meet(state: Column, new: Column, level: int) -> Column:
    """The state after its undecided document has met a new one."""
    a, b = state["open"], new
    room_a, mass_a = (1 - a["p"]) * a["w"], a["p"] * a["w"]
    room_b, mass_b = (1 - b["p"]) * b["w"], b["p"] * b["w"]
    up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)  # words that a can win or lose
    wins = uniform(a["doc_id"], a["source"], b["doc_id"], b["source"], F.lit(SEED + level)) * (up + down) < down
    a_done = F.when(wins, room_a <= mass_b).otherwise(mass_a <= room_b)
    b_done = F.when(wins, mass_b <= room_a).otherwise(room_b <= mass_a)
    doc = lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["w"].alias("w"), p.alias("p"))
    a_left = doc(a, F.when(wins, mass_a + up).otherwise(mass_a - down) / a["w"])
    b_left = doc(b, F.when(wins, mass_b - up).otherwise(mass_b + down) / b["w"])
    sealed = lambda x, copies: F.struct(x["doc_id"].alias("doc_id"), x["source"].alias("source"), copies.cast("int").alias("extra"))
    done = state["done"]
    done = F.when(a_done, F.concat(done, F.array(sealed(a, wins)))).otherwise(done)
    done = F.when(b_done, F.concat(done, F.array(sealed(b, ~wins)))).otherwise(done)
    both = F.when(a_done & b_done, F.lit(None)).when(a_done, b_left).otherwise(a_left)
    return F.when(a.isNull(), F.struct(doc(b, b["p"]).alias("open"), state["done"].alias("done"))).otherwise(F.struct(both.alias("open"), done.alias("done")))


def _round_level(rows: DataFrame, level: int) -> DataFrame:
    """rows (doc_id, source, block, w, p) to open and done of each block."""
    kinds = dict(rows.dtypes)
    start = F.expr(f"named_struct('open', cast(null as struct<doc_id:{kinds['doc_id']},source:string,w:double,p:double>), 'done', cast(array() as array<struct<doc_id:{kinds['doc_id']},source:string,extra:int>>))")
    members = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("neg"), "doc_id", "source", "w", "p")))
    folded = F.aggregate(F.col("members"), start, lambda s, x: _meet(s, x, level))
    return rows.groupBy("source", "block").agg(members.alias("members")).select("block", folded.alias("state"))


def copies(units: DataFrame) -> DataFrame:
    """units (doc_id, source, size, rows; one row each) to doc_id, source, the copies that all of its rows are taken, with source_size and target."""
    targets = store(source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size"))), "targets")
    known = targets.select(F.col("source").alias("of"), "source_size", "target", "due")
    few = targets.count() <= 100_000  # a row a source: broadcast only if they are few, else let AQE split the hot ones
    rows = units.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    due = F.when(F.col("size") > 0, F.col("due") * F.col("rows")).otherwise(0.0)
    rows = store(rows.withColumn("whole", F.floor(due)).withColumn("p", due - F.floor(due)), "due")
    open_rows = rows.where(F.col("p") > 0)
    sizes = open_rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("of"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    placed = open_rows.join(F.broadcast(sizes) if few else sizes, F.col("source").eqNullSafe(F.col("of")))
    todo = placed.select("doc_id", "source", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("blocks")).alias("block"), F.col("size").cast("double").alias("w"), "p")
    sealed, level = [], 0
    while most:
        state = store(_round_level(todo, level), "rounding")
        sealed.append(state.select(F.explode("state.done").alias("x")).select("x.doc_id", "x.source", "x.extra"))
        left = state.where(F.col("state.open").isNotNull()).select("state.open.doc_id", "state.open.source", F.floor(F.col("block") / BLOCK).alias("block"), "state.open.w", "state.open.p")
        if most == 1:  # one document of each source at most is still open
            sealed.append(left.select("doc_id", "source", (uniform(F.col("doc_id"), F.col("source"), F.lit(SEED - 1)) < F.col("p")).cast("int").alias("extra")))
            break
        todo, level, most = left, level + 1, -(-most // BLOCK)
    if not sealed:
        return rows.select("doc_id", "source", F.col("whole").alias("copies"), "source_size", "target")
    extra = sealed[0]
    for x in sealed[1:]:
        extra = extra.unionByName(x)
    extra = extra.select(F.col("doc_id").alias("x_id"), F.col("source").alias("x_source"), "extra")
    done = rows.join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & F.col("source").eqNullSafe(F.col("x_source")), "left")
    return done.select("doc_id", "source", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"), "source_size", "target")


def _keys(docs: DataFrame) -> list[Column]:
    """A hash of 128 bits of all columns that can be hashed."""
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(k), *own) for k in (0, 1)]


def unit_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """a, b (the hash of the row), doc_id, source, size, rows (how many are equal), source_size, target, copies (of all of them)."""
    a, b = _keys(docs)
    rows = docs.select(a.alias("a"), b.alias("b"), F.col(doc_id).alias("own_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    units = store(rows.groupBy("a", "b", "own_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("doc_id", F.concat_ws(".", "a", "b")), "units")
    known = copies(units.select("doc_id", "source", "size", "rows")).select("doc_id", "copies", "source_size", "target")
    return units.join(known, "doc_id").select("a", "b", F.col("own_id").alias("doc_id"), "source", "size", "rows", "source_size", "target", "copies")


def mixed_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    units = unit_copies(docs, doc_id, source, text)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("k") <= F.col("copies") % F.col("rows")).cast("long")
    out = units.withColumn("k", each).withColumn("copies", share)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs, each row as often as it is taken; same columns. One of equal rows stands for all of them, as often as they are taken together."""
    names = docs.columns
    a, b, n = (fresh(x, names) for x in ("copies_a", "copies_b", "copies_taken"))
    known = unit_copies(docs, doc_id, source, text).where("copies > 0").select(F.col("a").alias(a), F.col("b").alias(b), F.col("copies").alias(n))
    keys = _keys(docs)
    out = docs.withColumns({a: keys[0], b: keys[1]}).dropDuplicates([a, b]).join(known, [a, b])
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))
    return out.select(*(F.col(f"`{x}`") for x in names), again.alias(n)).drop(n)


def query(docs: DataFrame) -> DataFrame:
    return mixed_copies(docs).select("doc_id", "size", "source_size", "target", "taken")
