"""Quality rules: rule statistics of whole texts and an isolation forest on them.

A document fails at once if a base rule fails. Otherwise its statistics run down a forest of random splits, grown on
labelled documents of good quality: a short mean path marks a document unlike these. The threshold of the anomaly score is
calibrated on labelled rows: the lowest score that rejects at most false_reject of the good ones, moved up into the middle
of the widest gap between it and the next bad score.

No sample: the box of the splits, the numbers of rows in the nodes of every tree and the threshold come from all labelled documents that pass
the base rules. Their statistics are stored, and a job a level counts them where they are. The driver and each worker hold the
forest: a tree has at most 2 ** (DEEPEST + 1) nodes, and parts no node of fewer than two good rows. Statistics and verdicts cover every document.

Nulls: a null or empty text has no words, so it fails. A null doc_id is never labelled. Without labelled rows of good quality the base rules
alone decide. Rows that repeat get equal verdicts. An empty table gives an empty result. Other columns pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, store
from tessera.llm.packed import texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES, DEEPEST = 100, 16
FALSE_REJECT = 0.002
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate")
#: Labelled rows in a task, and parts of a range of scores in a pass over them.
LABELLED_ROWS, BINS = 16_384, 4096
#: Words of an ordinary text that a document's window repeats are counted by sorting; beyond this the ids still fit 64 bits.
_ID_BITS = 21


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text holds at least twice, the first of them included."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if len(names) < 1 << _ID_BITS:
        keys = (ids[:-2] << 2 * _ID_BITS) | (ids[1:-1] << _ID_BITS) | ids[2:]
    else:
        pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1] * len(names) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(n, bool)
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[starts + k] = True
    return int(hit.sum())


def counts(data: bytes | None) -> tuple[int, int, int, int, int]:
    """The statistics COUNTS of one text."""
    if not data:
        return 0, 0, 0, 0, 0
    words = data.split()  # of bytes: exactly the six spaces
    chars = len(data.decode("utf-8", "replace")) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(data.count(b"%c" % x) for x in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def with_counts(docs: DataFrame, text: str, names: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all of them) of docs, and COUNTS."""
    kept = docs.columns if keep is None else keep

    def stats(batches):
        for batch in batches:
            found = np.array([counts(x) for x in texts(batch, text)], np.int64).reshape(-1, len(COUNTS))
            out = pa.Table.from_batches([batch]).select(kept)
            for k, name in enumerate(COUNTS):
                out = out.append_column(names[name], pa.array(found[:, k], pa.int64()))
            yield from out.to_batches()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name in kept] + [T.StructField(names[x], T.LongType()) for x in COUNTS])
    return docs.mapInArrow(stats, schema)


def features(found: np.ndarray) -> np.ndarray:
    """Rates that do not depend on a text's length, from columns in the order of COUNTS."""
    words = np.maximum(found[:, 0], 1).astype(float)
    chars = np.maximum(found[:, 1], 1).astype(float)
    return np.stack([found[:, 1] / words, np.log1p(1000 * found[:, 2] / chars), np.log1p(100 * found[:, 3] / words), np.log1p(100 * found[:, 4] / words)], axis=1)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n points."""
    more = np.maximum(n, 3).astype(float)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(more - 1) + 0.5772156649015329) - 2 * (more - 1) / more))


class IsolationForest:
    """Trees of random splits; the nodes of all trees lie in the same arrays, the roots first, a node's children at its left and left + 1.

    A split's value is drawn from the node's box, which starts as the range of every labelled row, good or not: so regions
    that no good document reaches are parted as well, and a document there ends after few splits. Every tree holds all good rows: count
    gives the number of them that end at each node from the given one on, and is asked once a level.
    """

    def __init__(self, rows: int, box: np.ndarray, count: Callable[[IsolationForest, int], np.ndarray], trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.expected = trees, max(float(_mean_path(np.array(rows))), 1.0)
        self.feature, self.split, self.left, self.path = (np.zeros(0, x) for x in (np.int8, float, np.int32, float))
        deepest = min(DEEPEST, 2 * math.ceil(math.log2(max(rows, 2))))
        low, high = (np.tile(x, (trees, 1)) for x in box)
        for depth in range(deepest + 1):
            start = len(self.feature)
            self._add(len(low))
            number = count(self, start) if depth else np.full(trees, rows)
            self.path[start:] = depth + _mean_path(number)
            ways = (high > low).sum(axis=1)
            parted = np.flatnonzero((number > 1) & (ways > 0))
            if depth == deepest or not len(parted):
                break
            low, high, k = low[parted], high[parted], np.arange(len(parted))
            nth = rng.integers(ways[parted])
            f = (np.cumsum(high > low, axis=1) <= nth[:, None]).sum(axis=1)
            split = rng.uniform(low[k, f], high[k, f])
            at = start + parted
            self.feature[at], self.split[at], self.left[at] = f, split, len(self.feature) + 2 * k
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            high[2 * k, f] = low[2 * k + 1, f] = split

    def _add(self, n: int) -> None:
        """n leaves."""
        self.feature = np.append(self.feature, np.full(n, -1, np.int8))
        self.split, self.path = (np.append(x, np.zeros(n)) for x in (self.split, self.path))
        self.left = np.append(self.left, np.zeros(n, np.int32))

    def ends(self, tree: int, rows: np.ndarray) -> np.ndarray:
        """The leaf of a tree that each row ends at."""
        at = np.full(len(rows), tree, np.int64)
        inner = np.arange(len(rows))
        while True:
            f = self.feature[at[inner]]
            inner, f = inner[f >= 0], f[f >= 0]
            if not len(inner):
                return at
            at[inner] = self.left[at[inner]] + (rows[inner, f] >= self.split[at[inner]])

    def reached(self, rows: np.ndarray, start: int) -> np.ndarray:
        """Number of rows that end at each node from start on."""
        ends = [self.ends(tree, rows) - start for tree in range(self.trees)]
        return np.bincount(np.concatenate([x[x >= 0] for x in ends]), minlength=len(self.feature) - start)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): high for short paths."""
        total = np.zeros(len(rows))
        for tree in range(self.trees):
            total += self.path[self.ends(tree, rows)]
        return 2.0 ** (-total / max(self.trees, 1) / self.expected)


def _matrix(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names], axis=1)


def labelled_features(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """good and FEATURES of every labelled document that passes the base rules, stored; counted: own_id and COUNTS of the documents."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("marked_id")).agg((F.min("quality") > 0).alias("good"))
    rows = counted.where(_passes(COUNTS[0], COUNTS[-1])).join(marks, F.col("own_id") == F.col("marked_id"))
    rows = rows.groupBy("own_id").agg(F.min("good").alias("good"), *(F.min(x).alias(x) for x in COUNTS))

    def rates(batches):
        for batch in batches:
            found = features(_matrix(batch, COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("good"), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], ["good", *FEATURES])

    tasks = max(1, -(-labels.count() // LABELLED_ROWS))
    return store(rows.repartition(tasks, "own_id").mapInArrow(rates, "good boolean, " + ", ".join(f"{x} double" for x in FEATURES)), "quality-labelled")


def counter(good: DataFrame) -> Callable[[IsolationForest, int], np.ndarray]:
    """The count of a forest over all rows of good."""

    def count(forest: IsolationForest, start: int) -> np.ndarray:
        def ends(batches):
            found = np.zeros(len(forest.feature) - start, np.int64)
            for batch in batches:
                found += forest.reached(_matrix(batch, FEATURES), start)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["node", "n"])

        got = good.mapInArrow(ends, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
        found = np.zeros(len(forest.feature) - start, np.int64)
        found[got.column("node").to_numpy()] = got.column("n").to_numpy()
        return found

    return count


def value_at(rows: DataFrame, column: str, rank: int) -> float:
    """The value of that rank, from 0, in ascending order: exact.

    Each pass parts the range that holds it into BINS, of which the driver gets number, least and greatest value.
    """
    value = F.col(column)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        part = F.floor((value - F.lit(low)) / F.lit(high - low) * BINS)
        bins = rows.where(value.between(low, high)).groupBy(part.alias("part")).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for x in sorted(bins.collect(), key=lambda x: x["part"]):
            if rank < x["n"]:
                break
            rank -= x["n"]
        low, high = x["low"], x["high"]
    return low


def calibrated(scored: DataFrame, n_good: int, false_reject: float = FALSE_REJECT) -> float:
    """The score above which a document is rejected, from all rows of good and score, n_good of them good."""
    limit = value_at(scored.where("good"), "score", math.ceil((n_good - 1) * (1 - false_reject)))
    (above,) = scored.where(~F.col("good") & (F.col("score") > limit)).agg(F.min("score")).first()
    return limit if above is None else (limit + above) / 2


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = TREES) -> tuple[IsolationForest, float] | None:
    """The forest and its threshold, from every labelled row; None without good ones."""
    own = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("own_text"))
    return fitted_on_counts(with_counts(own, "own_text", {x: x for x in COUNTS}, ["own_id"]), labels, trees)


def fitted_on_counts(counted: DataFrame, labels: DataFrame, trees: int = TREES) -> tuple[IsolationForest, float] | None:
    """fitted, from own_id and COUNTS of the documents."""
    rows = labelled_features(counted, labels)
    n_good, *box = rows.agg(F.count_if("good"), *(F.min(x) for x in FEATURES), *(F.max(x) for x in FEATURES)).first()
    if not n_good:
        return None
    forest = IsolationForest(n_good, np.array(box).reshape(2, -1), counter(rows.where("good")), trees)

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(forest.score(_matrix(batch, FEATURES)))], ["good", "score"])

    return forest, calibrated(store(rows.mapInArrow(scores, "good boolean, score double"), "quality-scores"), n_good)


def _passes(words: str, repeats: str) -> Column:
    """The base rules."""
    return (F.col(words) >= MIN_WORDS) & (100 * F.col(repeats) <= MAX_REPEAT_PERCENT * F.col(words))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with COUNTS, base_failed, anomaly and kept; and the names that these columns got. Texts are counted once: rows are stored with their counts."""
    names = verdict_names(docs)
    counted = store(with_counts(docs, text, names), "quality-counts")
    own = counted.select(F.col(f"`{doc_id}`").alias("own_id"), *(F.col(names[x]).alias(x) for x in COUNTS))
    return with_verdicts(counted, names, fitted_on_counts(own, labels)), names


def verdict_names(docs: DataFrame) -> dict[str, str]:
    taken = list(docs.columns)
    names = {}
    for x in (*COUNTS, "base_failed", "anomaly", "kept"):
        names[x] = fresh(x, taken)
        taken.append(names[x])
    return names


def with_verdicts(counted: DataFrame, names: dict[str, str], model: tuple[IsolationForest, float] | None) -> DataFrame:
    """counted with base_failed, anomaly and kept."""
    out = counted.withColumn(names["base_failed"], ~_passes(names[COUNTS[0]], names[COUNTS[-1]]))
    if model is None:
        return out.withColumn(names["anomaly"], F.lit(0.0)).withColumn(names["kept"], ~F.col(names["base_failed"]))
    forest, most = model

    @F.pandas_udf("double")
    def anomaly(*columns):
        import pandas as pd

        return pd.Series(forest.score(features(np.stack([c.to_numpy(np.int64) for c in columns], axis=1).reshape(-1, len(COUNTS)))))

    out = out.withColumn(names["anomaly"], anomaly(*(F.col(names[x]) for x in COUNTS)))
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["anomaly"]) <= F.lit(most)))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    out, names = judged(docs, labels)
    return out.where(F.col(names["kept"])).select(*(F.col(f"`{x}`") for x in docs.columns))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    names = verdict_names(docs.select("doc_id", "text"))
    counted = store(with_counts(docs.select("doc_id", "text"), "text", names, ["doc_id"]), "quality-counts")
    model = fitted_on_counts(counted.withColumnRenamed("doc_id", "own_id"), labels)
    return with_verdicts(counted, names, model).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
