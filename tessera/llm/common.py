"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: A null doc_id sorts after every other one.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session without a cluster gets a temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.tessera.dir", None)
    if not found:
        if not (conf.get("spark.master") or "").startswith("local") or (conf.get("spark.master") or "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """name, made longer until no column of taken clashes with it."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words between runs of SPACES; 0 for null."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, SPACES))).otherwise(0).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values of cols alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    return rows, int(size)
