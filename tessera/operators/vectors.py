"""Vectors against query vectors in blocks (inventory V3, V9, V14, F1, F3, F12, F15, Q8).

Vectors are dealt by a hash into parts of bounded size, queries into blocks; each part meets each block once, in a cell that multiplies two matrices and
tells partial results: the k nearest of each query, or for each query and document the best and second score, the chunk that has the best, and the number of chunks.
Partials merge in any order by one aggregate, so a document may be spread over parts. No pair of vectors is ever a row, and no query passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a part and queries a block at most (about, as a hash deals them), and scores that are held at once.
PART_ROWS, BLOCK_ROWS, SCORES = 1 << 14, 1 << 12, 1 << 22


def _dealt(df: DataFrame, key: str, rows: int) -> tuple[Column, int]:
    n = max(1, -(-df.count() // rows))
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), n


def in_cells(vectors: DataFrame, queries: DataFrame, cell: Callable, schema: str, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What cell(vectors, queries) tells of each part of vectors (chunk_id, v, ...) and block of queries (query_id, q, ...); rows without a vector are left out."""
    vectors, queries = vectors.where("v IS NOT NULL"), queries.where("q IS NOT NULL")
    part, parts = _dealt(vectors, "chunk_id", part_rows)
    block, blocks = _dealt(queries, "query_id", block_rows)
    left = vectors.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(cell, schema)


def _matrices(table: pa.Table, column: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    lists = table.column(column).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    return {int(n): (at, flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(sizes) if len(at := np.flatnonzero(sizes == n))}


def _products(vectors: pa.Table, queries: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of queries, rows of vectors and their scores, of vectors of the same length, some queries at a time."""
    held = _matrices(vectors, "v")
    for n, (asked, q) in _matrices(queries, "q").items():
        if n in held:
            rows, v = held[n]
            step = max(1, SCORES // len(rows))
            for k in range(0, len(asked), step):
                yield asked[k : k + step], rows, q[k : k + step] @ v.T


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _nearest(k: int):
    def nearest(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(vectors) and len(queries):
            chunk, query = _numbers(vectors, "chunk_id"), _numbers(queries, "query_id")
            for asked, rows, scores in _products(vectors, queries):
                shown = np.round(scores, 6)
                # Ties at the k-th place stay all: the last ranking settles them by chunk.
                least = np.partition(shown, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(asked), -np.inf)
                a, b = np.nonzero(shown >= least[:, None])
                for column, x in zip(out, (query[asked[a]], chunk[rows[b]], scores[a, b]), strict=True):
                    column.append(x)
        return pa.table({name: np.concatenate(x) for name, x in zip(("query_id", "chunk_id", "score"), out, strict=True)})

    return nearest


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score: for each query the k nearest by dot product, and those that tie with the last."""
    return in_cells(vectors.select("chunk_id", "v"), queries.select("query_id", "q"), _nearest(k), "query_id long, chunk_id long, score double")


def _best_of(vectors: pa.Table, queries: pa.Table) -> pa.Table:
    """For each query and document of a cell: best, its chunk (the smallest of equal ones), second (null for a single chunk), and number of chunks."""
    names, kinds = ("query_id", "doc", "best", "chunk_id", "second", "n"), (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
    out = []
    if len(vectors) and len(queries):
        chunk, query = _numbers(vectors, "chunk_id"), _numbers(queries, "query_id")
        docs = vectors.column("doc").combine_chunks().dictionary_encode("encode")  # a null document is one of its own
        docs = pa.concat_arrays(docs.chunks).unify_dictionaries() if isinstance(docs, pa.ChunkedArray) else docs
        code, doc_names = docs.indices.to_numpy(zero_copy_only=False), docs.dictionary
        for asked, rows, scores in _products(vectors, queries):
            order = np.lexsort((chunk[rows], code[rows]))
            rows, scores = rows[order], np.round(scores[:, order], 6)
            starts = np.flatnonzero(np.append(True, np.diff(code[rows]) != 0))
            sizes = np.diff(np.append(starts, len(rows)))
            best = np.maximum.reduceat(scores, starts, axis=1)
            at = np.minimum.reduceat(np.where(scores == np.repeat(best, sizes, axis=1), np.arange(len(rows)), len(rows)), starts, axis=1)
            scores[np.arange(len(asked))[:, None], at] = -np.inf
            second = np.maximum.reduceat(scores, starts, axis=1)
            n = best.size
            columns = (np.repeat(query[asked], len(starts)), doc_names.take(pa.array(np.tile(code[rows[starts]], len(asked)))), best.ravel(), chunk[rows[at.ravel()]])
            out.append(pa.table([*map(pa.array, columns[:1]), columns[1], *map(pa.array, columns[2:]), pa.array(second.ravel(), mask=second.ravel() == -np.inf), pa.array(np.tile(sizes, n // len(sizes)))], names=names))
    return pa.concat_tables(out).cast(pa.schema(list(zip(names, kinds, strict=True)))) if out else pa.table({k: pa.array([], t) for k, t in zip(names, kinds, strict=True)})


def doc_max(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc, best, chunk_id, second, n over vectors (chunk_id, v, doc): partials of all cells, merged."""
    partial = in_cells(vectors.select("chunk_id", "v", F.col("doc").cast("string").alias("doc")), queries.select("query_id", "q"), _best_of, "query_id long, doc string, best double, chunk_id long, second double, n long")
    first = F.max(F.struct("best", (-F.col("chunk_id")).alias("minus")))
    two = F.sort_array(F.flatten(F.collect_list(F.array_compact(F.array("best", "second")))), asc=False)  # two numbers a cell
    merged = partial.groupBy("query_id", "doc").agg(first.alias("first"), F.get(two, F.lit(1)).alias("second"), F.sum("n").cast("long").alias("n"))
    return merged.select("query_id", "doc", F.col("first.best").alias("best"), (-F.col("first.minus")).alias("chunk_id"), "second", "n")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k first of each query by score, ties by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
