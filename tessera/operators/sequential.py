"""Operators that are sequential by nature, and codecs that SQL lacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.registry import frame


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_cites(text: Column, n: Column) -> Column:
    """text without the brackets of citations [k] where k is not in 1..n; the number itself stays. Unchanged if n is 0 or null."""
    number = lambda x: F.when(x.rlike(r"^\[[0-9]+\]$"), F.coalesce(F.substring(x, F.lit(2), F.length(x) - 2).try_cast("long"), F.lit(0)))
    pieces = F.split(text, r"(?=\[[0-9]+\])|(?<=\])")
    kept = F.transform(pieces, lambda x: F.when(~number(x).between(1, n), F.regexp_replace(x, r"[\[\]]", "")).otherwise(x))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.array_join(kept, "")).otherwise(text)


_CITED = "concat('[', turn + 1, '] ', text, ' [', turn, '][0] [12]')"


@frame(
    f"SELECT conv_id, turn, CASE WHEN turn = 0 THEN {_CITED} ELSE regexp_replace({_CITED}, '\\[(0|[1-9][0-9]+|[' || (turn + 1) || '-9])\\]', '\\1', 'g') END AS answer FROM conversations"
)
def drop_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn cites its own place, the next and two more, of as many passages as its place says."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", valid_cites(F.expr(_CITED), F.col("turn")).alias("answer"))


def grown(sizes: np.ndarray, hit: int, budget: int) -> tuple[int, int]:
    """First and last place around hit, grown by turns after and before it; a side ends where its next place is over the budget."""
    first = last = hit
    left, open_sides = budget - int(sizes[hit]), [1, -1]
    while open_sides:
        for side in tuple(open_sides):
            at = last + 1 if side > 0 else first - 1
            if not 0 <= at < len(sizes) or sizes[at] > left:
                open_sides.remove(side)
                continue
            left -= int(sizes[at])
            first, last = min(first, at), max(last, at)
    return first, last


def expanded(sections: DataFrame, budget: int) -> DataFrame:
    """sections, a row each with sizes array<int> and the place hit in it, to the places first..last around the hit. Null or empty sizes give nulls."""

    @F.pandas_udf("first int, last int")
    def spread(sizes: pd.Series, hit: pd.Series) -> pd.DataFrame:
        out = [(None, None) if s is None or not len(s) or pd.isna(h) else grown(s, int(h), budget) for s, h in zip(sizes, hit, strict=True)]
        return pd.DataFrame(out, columns=["first", "last"]).astype("Int32")

    return sections.withColumn("span", spread("sizes", "hit")).select(*sections.columns, "span.first", "span.last")


@frame()
def parent_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a section, its lines are chunks, and its longest line is the hit; 128 words may be taken."""
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), words).alias("sizes"))
    hits = lines.withColumn("hit", (F.array_position("sizes", F.array_max("sizes")) - 1).cast("int"))
    took = F.aggregate(F.slice("sizes", F.col("first") + 1, F.col("last") - F.col("first") + 1), F.lit(0), lambda a, x: a + x)
    return expanded(hits, 128).select("doc_id", "hit", "first", "last", took.alias("n_words"))


def grams(text: str) -> frozenset[str]:
    """Pairs of neighbouring characters, white space left out."""
    bare = "".join((text or "").split())
    return frozenset(map("".join, zip(bare, bare[1:])))


def brief(items: DataFrame, group: str, order: str, text: str, limit: int = 3, same: float = 0.8) -> DataFrame:
    """The first items of each group whose texts are not nearly one already picked, at most limit, numbered from 1.

    Groups lie sorted in their partition and are read as a stream: what is held is the pairs of the picked texts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, picked = object(), []
        for f in frames:
            rows = []
            for g, o, t in zip(f[group], f[order], f[text], strict=True):
                if g != now:
                    now, picked = g, []
                if len(picked) == limit:
                    continue
                own = grams(t)
                if all(len(own & other) < same * max(1, min(len(own), len(other))) for other in picked):
                    picked.append(own)
                    rows.append((g, o, len(picked)))
            yield pd.DataFrame(rows, columns=[group, order, "no"])

    kinds = dict(items.dtypes)
    laid = items.select(group, order, text).where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, order, text)
    return laid.mapInPandas(run, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, no int")


@frame()
def brief_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three distinct turns of every conversation."""
    return brief(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@F.pandas_udf(ArrayType(FloatType()))
def to_half_and_back(vectors: pd.Series) -> pd.Series:
    """Each number rounded to the nearest 16-bit float, ties to even."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))


@frame()
def f16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error and squared length of every vector after 16-bit floats."""
    pair = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", to_half_and_back("embedding").alias("half"))
    error = F.array_max(F.zip_with("embedding", "half", lambda a, b: F.abs(a - b)))
    square = F.aggregate("half", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return pair.select("vec_id", error.alias("max_error"), F.round(square, 6).alias("squared_length"))
