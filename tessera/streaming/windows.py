"""Streams (inventory T): batch twins with SQL, and their Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.registry import frame, sql


@sql
def debounce_sessions(d):
    """Events of a user less than an hour apart settle together."""
    ts = d.epoch("ts")
    return f"""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN {ts} - lag({ts}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600 THEN 0 ELSE 1 END AS starts FROM {d.table('events')}),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY user_id, session"""


@sql
def tumbling_counts(d):
    hour = d.hour("ts")
    return f"SELECT {hour} AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {d.table('events')} GROUP BY {hour}, event_type"


@sql
def dedup_window(d):
    """The variant by the event before: an event within ten minutes of the user's last one of its type is dropped."""
    ts = d.epoch("ts")
    return f"""WITH g AS (SELECT event_id, user_id, event_type, {ts} - lag({ts}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM {d.table('events')}) SELECT event_id, user_id, event_type FROM g WHERE gap IS NULL OR gap >= 600"""


@sql
def recent_history(d):
    """The ten newest conversations with their last twenty turns."""
    c = d.table("conversations")
    return f"""WITH l AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id DESC) AS k FROM (SELECT DISTINCT conv_id FROM {c}) z), t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {c})
SELECT t.conv_id, t.turn, t.role FROM t JOIN l ON l.conv_id = t.conv_id WHERE l.k <= 10 AND t.n <= 20"""


@sql
def coalesce_events(d):
    return f"SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_event FROM {d.table('events')} GROUP BY user_id, event_type"


# Structured Streaming


def stream_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def stream_settled(events: DataFrame, quiet: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed after so long without an event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", quiet), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def stream_accepted(events: DataFrame, seconds: float = 600.0) -> DataFrame:
    """Exact duplicate suppression: an event counts if so long has passed since the last accepted one of its user and type.

    A suppressed event does not move that clock. State is one number a key; it ends when no event came for a day.
    """

    def accept(key, batches: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for at, event in zip(rows["ts"].astype("int64") / (1e9 if rows["ts"].dtype == "datetime64[ns]" else 1e6), rows["event_id"], strict=True):
            if at - last >= seconds:
                kept.append(event)
                last = at
        state.update((last,))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({"event_id": pd.Series(kept, dtype="int64"), "user_id": key[0], "event_type": key[1]})

    return events.groupBy("user_id", "event_type").applyInPandasWithState(accept, "event_id long, user_id long, event_type string", "last double", "append", "ProcessingTimeTimeout")


def _streamed(spark, d, make, mode: str) -> DataFrame:
    """Read the events table as a stream to its end, and give what `make` wrote; state and output lie below the shared folder."""
    from tessera.operators.index import shared_path

    path = shared_path(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = make(events)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'all' if mode == 'complete' else number}")

    # One batch: a stream with processing-time timeouts always has another to run, and would not end by itself.
    started = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(once=True).foreachBatch(put).start()
    started.awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


@frame("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def streamed_counts(spark, d):
    """The hourly counts by the stream, read to its end."""
    return _streamed(spark, d, stream_counts, "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@frame()
def streamed_accepted(spark, d):
    """Events that the stream accepts: each ten minutes or more after the last accepted one of its user and type."""
    return _streamed(spark, d, stream_accepted, "append")


@frame()
def accepted_events(spark, d):
    """The batch form of streamed_accepted: a fold over each key's events in order of time."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", F.struct(at.alias("at"), "event_id").alias("e"))
    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, e: F.when(e["at"] - s["last"] >= 600, F.struct(e["at"].alias("last"), F.concat(s["kept"], F.array(e["event_id"])).alias("kept"))).otherwise(s)
    kept = rows.groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("e")).alias("es")).select("user_id", "event_type", F.aggregate("es", start, step)["kept"].alias("kept"))
    return kept.select(F.explode("kept").alias("event_id"), "user_id", "event_type")
