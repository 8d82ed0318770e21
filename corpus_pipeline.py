"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage is given its predecessor's rows as docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, packing, quality, simhash
from tessera.llm.common import store, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text. Texts that keep no word go."""
    out = line_dedup.dedup_lines(docs)
    text = F.col("text")
    return out.withColumn("n_chars", F.length(text).cast("long")).where(text.isNull() | text.rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("simhash_near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: A forest, SimHash groups and a packing of bins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
