"""Models as functions handed in: embedding of texts (inventory V1) and scores of pairs (R4)."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import frame

#: Texts that a task has as Python objects at once.
TEXTS = 256
#: Texts to hidden states (texts, tokens, dimensions) and the mask of real tokens (texts, tokens).
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the real tokens' states, of length one; zero for a text without tokens."""
    weight = mask.astype(np.float32)[:, :, None]
    mean = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def embedded(texts: DataFrame, make: Callable[[], Encode], prefix: str = "", batch: int = 32) -> DataFrame:
    """texts (id, text) with `embedding`; make() loads the model once in each task, which encodes prefix and text in batches. A null text is empty."""

    def run(parts):
        encode = make()
        for part in (whole.slice(at, TEXTS) for whole in parts for at in range(0, whole.num_rows, TEXTS)):
            ids, rows = part.column("id"), [prefix + (t or "") for t in part.column("text").to_pylist()]
            vectors = [v for k in range(0, len(rows), batch) for v in pooled(*encode(rows[k : k + batch]))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float32()))], ["id", "embedding"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


def scored(pairs: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None) -> DataFrame:
    """pairs (query, text, ...) with `score`, by a model that make() loads in each task, or, without one, by the share of the query's words in the text.

    Words are split at white space and compared in lower case; nulls are empty, and a query without words scores 0.
    """
    if make is None:
        words = lambda c: F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")), lambda w: w != "")
        asked = words(F.col("query"))
        return pairs.withColumn("score", F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(F.col("text")))) / F.size(asked)).otherwise(0.0))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pairs.schema)}, score double"

    def run(parts):
        score = make()
        for part in parts:
            given = [[x or "" for x in part.column(c).to_pylist()] for c in ("query", "text")]
            yield part.append_column("score", pa.array([float(x) for x in score(*given)], pa.float64()))

    return pairs.mapInArrow(run, schema)


def hashed_words(dimensions: int = 32) -> Encode:
    """A stand-in for a model: a word's state is set by its hash."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [t.split() for t in texts]
        width = max(map(len, rows), default=0)
        hidden = np.zeros((len(rows), width, dimensions), np.float32)
        for r, words in enumerate(rows):
            for k, word in enumerate(words):
                h = crc32(word.encode())
                hidden[r, k, h % dimensions] = 1 if h >> 16 & 1 else -1
        return hidden, np.array([[k < len(x) for k in range(width)] for x in rows], bool).reshape(len(rows), width)

    return encode


@frame()
def embed_texts(spark, d):
    """All documents under the stand-in encoder, one text at a time, since a batch is as wide as its longest text."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return embedded(docs, hashed_words, batch=1)


@frame(
    r"""WITH p AS (SELECT conv_id, turn, lower(text) AS text, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS query FROM conversations),
w AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(coalesce(query, ''), '[\s\x0B]+')), lambda x: x <> '') AS q, regexp_split_to_array(coalesce(text, ''), '[\s\x0B]+') AS t FROM p)
SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_filter(q, lambda x: list_contains(t, x))) / len(q), 6) END AS score FROM w"""
)
def pair_scores(spark, d):
    """Each turn of a conversation scored against the turn before it, by words."""
    from pyspark.sql.window import Window

    talk = spark.read.parquet(f"{d}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return scored(talk.select("conv_id", "turn", "text", before.alias("query"))).select("conv_id", "turn", F.round("score", 6).alias("score"))
