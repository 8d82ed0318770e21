"""A table of vectors that is changed in place and read merged (inventory S25-S29, V7, V10).

Rows lie in generations of Parquet files that never change. An upsert writes a generation of its rows and tombstones of their ids in the generations before; a delete
writes tombstones alone. A reader merges: rows of a generation that a tombstone covers are gone. The state, which generations and which tombstones count, is a manifest that is renamed whole
(sources/manifest.py), so every change happens entirely or not at all, and a change that was cut short leaves files that nothing reads. When more than DEAD of all rows
are gone, the living ones are written as one generation.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import read, shared_path
from tessera.registry import frame
from tessera.sources import manifest

VERSION, DEAD, BATCH = 1, 0.2, 64
MARKS = "chunk_id long, upto int"


class VectorTable:
    """Rows (chunk_id, doc, v, ...), one a chunk_id; v is null for a chunk whose vector is pending."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "chunk_id long, doc string, v array<float>"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def state(self) -> dict:
        found = manifest.load(self.spark, self.path, lambda x: x.get("version") == VERSION)
        return found or {"version": VERSION, "generations": [], "dead": None, "rows": 0, "gone": 0}

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def _marks(self, said: dict) -> DataFrame:
        return self.spark.read.schema(MARKS).parquet(f"{self.path}/{said['dead']}") if said["dead"] else self.spark.createDataFrame([], MARKS)

    def _living(self, said: dict) -> DataFrame:
        rows = None
        for k, name in enumerate(said["generations"]):
            own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("gen", F.lit(k))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return self.spark.createDataFrame([], f"{self.schema}, gen int")
        if not said["dead"]:
            return rows
        marks = self._marks(said)
        return rows.join(marks, "chunk_id", "left").where("upto IS NULL OR gen >= upto").drop("upto")

    def read(self) -> DataFrame:
        """The living rows."""
        said = self.state()
        names = self.spark.createDataFrame([], self.schema).columns
        return self._living(said).select(*names)

    def _buried(self, said: dict, ids: DataFrame) -> tuple[str, int]:
        """Tombstones with those of ids (chunk_id) in all generations so far; and how many living rows these cover."""
        n = self._living(said).join(ids.select("chunk_id"), "chunk_id", "left_semi").count()
        marks = ids.select("chunk_id", F.lit(len(said["generations"])).alias("upto")).distinct()
        return self._write(self._marks(said).unionByName(marks).groupBy("chunk_id").agg(F.max("upto").alias("upto")), "dead"), n

    def upsert(self, rows: DataFrame) -> None:
        """Put rows in, in place of those of the same chunk_id. A chunk_id may come once."""
        said = self.state()
        name = self._write(rows.select(*self.spark.createDataFrame([], self.schema).columns), "rows")
        own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
        n, distinct = own.agg(F.count(F.lit(1)), F.count_distinct("chunk_id")).first()
        if n != distinct:
            raise ValueError(f"{n} rows of {distinct} chunk_ids: each may come once, and none may be null")
        dead, gone = self._buried(said, own) if said["generations"] else (None, 0)
        self._put(said | {"generations": [*said["generations"], name], "dead": dead, "rows": said["rows"] + n, "gone": said["gone"] + gone})

    def delete(self, ids: DataFrame) -> None:
        """Take the rows of ids (chunk_id) out."""
        said = self.state()
        dead, gone = self._buried(said, ids)
        if gone:
            self._put(said | {"dead": dead, "gone": said["gone"] + gone})

    def delete_doc(self, docs: DataFrame, keep: DataFrame | None = None) -> None:
        """Take the rows of docs (doc) out, but for the chunks of keep (chunk_id)."""
        ids = self.read().join(docs.select("doc"), "doc", "left_semi").select("chunk_id")
        self.delete(ids if keep is None else ids.join(keep.select("chunk_id"), "chunk_id", "left_anti"))

    def set_payload(self, changes: DataFrame) -> None:
        """Put other values in columns of the rows of changes (chunk_id and these columns); unknown ids are left out, vectors stay."""
        new = [c for c in changes.columns if c != "chunk_id"]
        own = self.read().drop(*new).join(changes, "chunk_id")
        self.upsert(own)

    def _put(self, said: dict) -> None:
        said = manifest.save(self.spark, self.path, said)
        if said["gone"] > DEAD * said["rows"]:
            self.rebuild()

    def rebuild(self) -> None:
        """Write the living rows as one generation."""
        said = self.state()
        name = self._write(self._living(said).drop("gen"), "rows")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").count()
        manifest.save(self.spark, self.path, said | {"generations": [name], "dead": None, "rows": n, "gone": 0})

    def pending(self) -> DataFrame:
        return self.read().where("v IS NULL")

    def fill_pending(self, embed: Callable[[DataFrame], DataFrame], batches: int = 1024, batch: int = BATCH) -> int:
        """Give pending chunks the vectors of embed (rows to chunk_id, v), document by document, batches of batch chunks at a time; how many were filled.

        Each step is an upsert, so a run that is cut short goes on where it was. Chunks that embed tells no vector of stay pending.
        """
        done, after = 0, None
        while True:
            left = self.pending()
            if after is not None:
                left = left.where((F.col("doc") > F.lit(after[0])) | ((F.col("doc") == F.lit(after[0])) & (F.col("chunk_id") > F.lit(after[1]))))
            own = left.orderBy(F.col("doc").asc_nulls_first(), "chunk_id").limit(batches * batch)
            name = self._write(own, "step")
            step = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
            last = step.agg(F.max(F.struct("doc", "chunk_id")), F.count(F.lit(1))).first()
            if not last[1]:
                return done
            filled = step.drop("v").join(embed(step).where("v IS NOT NULL").select("chunk_id", "v"), "chunk_id")
            n = filled.count()
            if n:
                self.upsert(filled)
            done, after = done + n, (last[0]["doc"] or "", last[0]["chunk_id"])

    def unused(self) -> list[str]:
        """What lies at the path and no state names any more, for the caller to delete."""
        said = self.state()
        used = {*said["generations"], said["dead"]}
        return [x for x in manifest.names(self.spark, self.path) if x.split("-")[0] in ("rows", "dead", "step") and x not in used]


_TABLE_SQL = """WITH first AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 10 < 8),
put AS (SELECT * FROM first WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, label + 100, embedding FROM embeddings WHERE vec_id % 10 >= 8 OR vec_id % 7 = 0),
kept AS (SELECT * FROM put WHERE vec_id % 11 <> 0 AND NOT (label = 1 AND vec_id % 2 = 0))
SELECT vec_id, concat('doc', CASE WHEN vec_id % 13 = 0 THEN 'moved' ELSE CAST(label AS STRING) END) AS doc, round(embedding[1], 5) AS first_value, len(embedding)::BIGINT AS dims FROM kept"""


@frame(_TABLE_SQL)
def vector_table(spark, d):
    """A table of vectors built, then upserted, deleted by ids, by document but for some, moved and filled: what it holds in the end.

    Eight tenths of the vectors come first, a third of them pending; then the rest, and others anew.
    """
    table = VectorTable(spark, shared_path(spark), "chunk_id long, doc string, v array<float>, label int")
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("doc"), F.col("label").cast("string")).alias("doc"), F.col("embedding").cast("array<float>").alias("v"), "label")
    i = F.col("chunk_id")
    early = rows.where(i % 10 < 8)
    table.upsert(early.withColumn("v", F.when(i % 3 != 0, F.col("v"))))
    again = rows.where((i % 10 >= 8) | (i % 7 == 0))
    table.upsert(again.withColumn("label", F.col("label") + 100).withColumn("doc", F.concat(F.lit("doc"), F.col("label").cast("string"))))
    table.delete(rows.where(i % 11 == 0))
    table.delete_doc(rows.where("doc = 'doc1'").select("doc").distinct(), keep=rows.where(i % 2 == 1))
    table.fill_pending(lambda step: step.select("chunk_id").join(rows.select("chunk_id", "v"), "chunk_id"))
    table.set_payload(table.read().where(i % 13 == 0).select("chunk_id", F.lit("docmoved").alias("doc")))
    return table.read().select(i.alias("vec_id"), "doc", F.round(F.col("v")[0], 5).alias("first_value"), F.size("v").cast("long").alias("dims"))
