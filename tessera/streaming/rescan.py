"""A folder's state kept up to date from notices that come late or never (inventory T4 with T1-T3).

Notices (path, kind) only say where to look; what holds is the listing. Each batch of the stream looks at its own paths. A whole comparison of listing and state is made at the start, when
it is due, when it is asked for, and when a notice of kind `overflow` says that others were lost; it finds all that notices missed, so that the state ends as the listing whatever was lost.

State is a stored table: a base and the changes of later batches, the latest of a path counts, and a whole comparison writes a new base. The manifest carries the number of the last
batch; a batch that is run again after a crash finds its number there and does nothing, so each counts once. Work of a batch is a scan of the state and a join by path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import frame
from tessera.sources import manifest

LISTED = "path string, hash string"
LOGGED = "path string, op string, found string"


def state(spark: SparkSession, folder: str, said: dict | None = None) -> DataFrame:
    """path, hash of the files that the folder's newest state knows."""
    said = said if said is not None else manifest.load(spark, folder)
    if not said or not said["tables"]:
        return spark.createDataFrame([], LISTED)
    rows = None
    for turn, name in enumerate(said["tables"]):
        own = spark.read.schema("path string, hash string, gone boolean").parquet(f"{folder}/{name}").withColumn("turn", F.lit(turn))
        rows = own if rows is None else rows.unionByName(own)
    if len(said["tables"]) > 1:
        rows = rows.groupBy("path").agg(F.max_by(F.struct("hash", "gone"), "turn").alias("last")).select("path", "last.hash", "last.gone")
    return rows.where(~F.col("gone")).select("path", "hash")


def differences(listing: DataFrame, known: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """path, op (`new`, `changed`, `removed`), hash: what makes known the listing, of the given paths or of all. Repeated rows of a listing count once, of several hashes the greatest; null paths never."""
    now = listing.where("path IS NOT NULL").groupBy("path").agg(F.max(F.coalesce("hash", F.lit(""))).alias("hash"))
    if paths is not None:
        asked = paths.where("path IS NOT NULL").select("path").distinct()
        now, known = now.join(asked, "path", "left_semi"), known.join(asked, "path", "left_semi")
    both = now.join(known.withColumnRenamed("hash", "held"), "path", "full")
    op = F.when(F.col("held").isNull(), "new").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("held"), "changed")
    return both.select("path", op.alias("op"), "hash").where(F.col("op").isNotNull())


def apply_batch(spark: SparkSession, folder: str, listing: DataFrame, notices: DataFrame | None, number: int, now: float, every: float) -> dict:
    """Bring the folder's state in line: by the notices' paths, or by all where a whole comparison is due. Gives the state's manifest.

    number: of the batch, ascending; one that the state has seen changes nothing. now, every: seconds; 0 compares all at the start and on overflow alone. notices: null asks for a
    comparison of all. The differences are written first, then named by the manifest.
    """
    said = manifest.load(spark, folder) or {"batch": -1, "tables": [], "logs": [], "rescanned": None}
    if number <= said["batch"]:
        return said
    late = said["rescanned"] is None or (every > 0 and now - said["rescanned"] >= every)
    whole = notices is None or late or not notices.where(F.col("kind") == "overflow").isEmpty()
    known = state(spark, folder, said)
    tag = uuid.uuid4().hex
    found = differences(listing, known, None if whole else notices.where(F.col("kind") != "overflow"))
    found.withColumn("found", F.lit("rescan" if whole else "notice")).write.parquet(f"{folder}/log-{tag}")
    seen = spark.read.schema("path string, op string, hash string, found string").parquet(f"{folder}/log-{tag}")
    change = seen.select("path", "hash", (F.col("op") == "removed").alias("gone"))
    if whole:  # a new base: what stays and what changed
        kept = known.join(change, "path", "left_anti").select("path", "hash", F.lit(False).alias("gone"))
        change = kept.unionByName(change.where(~F.col("gone")))
    change.write.parquet(f"{folder}/state-{tag}")
    tables = [f"state-{tag}"] if whole else [*said["tables"], f"state-{tag}"]
    return manifest.save(spark, folder, {"batch": number, "tables": tables, "logs": [*said["logs"], f"log-{tag}"], "rescanned": now if whole else said["rescanned"]})


def follow(notices: DataFrame, listing: Callable[[], DataFrame], folder: str, checkpoint: str, clock: Callable[[], float], every: float = 600.0) -> None:
    """Run a stream of notices (path, kind) to its present end; each batch asks for the listing anew.

    A stream that starts again counts its batches from its checkpoint; with a new checkpoint they would start at 0, so folder and checkpoint belong together.
    """

    def put(batch: DataFrame, number: int) -> None:
        apply_batch(batch.sparkSession, folder, listing(), batch.persist(), number, clock(), every)
        batch.unpersist()

    notices.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def log(spark: SparkSession, folder: str) -> DataFrame:
    """path, op, found, turn: all differences that were found, in turn of batches."""
    said = manifest.load(spark, folder)
    rows = spark.createDataFrame([], LOGGED + ", turn int")
    for turn, name in enumerate(said["logs"] if said else []):
        rows = rows.unionByName(spark.read.schema(LOGGED).parquet(f"{folder}/{name}").withColumn("turn", F.lit(turn)))
    return rows


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Yesterday's and today's folder, drawn from the documents."""
    k = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.md5("text").alias("h"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), k.cast("string"))
    old = docs.where(k % 10 != 1).select(path.alias("path"), F.col("h").alias("hash"))
    new = docs.where(k % 10 != 2).select(path.alias("path"), F.when(k % 7 == 0, F.concat("h", F.lit("+"))).otherwise(F.col("h")).alias("hash"))
    return old, new


@frame(
    """WITH p AS (SELECT doc_id, concat('/corpus/', source, '/', doc_id) AS path, doc_id % 10 AS t, doc_id % 7 = 0 AS edited FROM documents),
o AS (SELECT path, doc_id, CASE WHEN t = 1 THEN 'new' WHEN t = 2 THEN 'removed' ELSE 'changed' END AS op FROM p WHERE t IN (1, 2) OR edited)
SELECT path, op, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.doc_id AND e.event_id % 3 <> 0) THEN 'notice' ELSE 'rescan' END AS found FROM o"""
)
def rescanned(spark, d):
    """Yesterday's folder is known; a stream tells of users' documents, a third of its notices lost; then all is compared. How each difference was found."""
    from tessera.operators.index import shared_path

    path = shared_path(spark)
    old, new = _snapshots(spark, d)
    apply_batch(spark, f"{path}/folder", old, None, 0, 0.0, 0.0)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").where(F.col("event_id") % 3 != 0)
    paths = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("user_id"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    notices = events.select("user_id").join(paths, "user_id").select("path", F.lit("changed").alias("kind"))

    def put(batch: DataFrame, number: int) -> None:
        apply_batch(spark, f"{path}/folder", new, batch, number + 1, 1.0, 0.0)

    notices.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    last = manifest.load(spark, f"{path}/folder")["batch"]
    apply_batch(spark, f"{path}/folder", new, None, last + 1, 2.0, 0.0)
    return log(spark, f"{path}/folder").where(F.col("turn") > 0).select("path", "op", "found")
