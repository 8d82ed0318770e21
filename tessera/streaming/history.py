"""Conversations of each user with their turns and uploaded files, kept as state of a stream (inventory T9, I16).

An event (user, conv, op, name, chunks, at, seq) of `turn`, `upload` or `remove` makes its conversation the user's newest. A user has MAX_CONVS conversations; one more lets go of the one
that was touched longest ago, with its files. A conversation has its last MAX_TURNS turns, and files of MAX_CHUNKS chunks together: a file that would pass that is refused. `remove` takes the
last file of that name; where there is none it is refused, and neither that nor an `upload` that is refused opens a conversation, but they touch one that is there.

State is one row for each conversation of a user in RocksDB, so it is bounded by users; a batch reads and writes the conversations of its own users alone. Events of a user are taken in order
of (at, seq) within a batch, and batches one after the other: what comes in a later batch counts as later. A user's events of one batch are in memory together; the source's limits bound a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import frame

# What is kept of a user and of a conversation.
MAX_CONVS, MAX_TURNS, MAX_CHUNKS = 10, 20, 3000
EVENTS = "user long, conv string, op string, name string, chunks long, at timestamp, seq long"
OUT = "user long, seq long, conv string, op string, verdict string, evicted string, turns int, files int, chunks long"
HELD = "touched long, turns array<long>, names array<string>, chunks array<long>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(held: dict[str, list], event: tuple) -> tuple:
    """Take one event (conv, op, name, chunks, seq) into held (conv -> [turn of touch, turns, names, chunks]); gives (verdict, evicted)."""
    conv, op, name, chunks, seq = event
    now = max((x[0] for x in held.values()), default=0) + 1
    own = held.get(conv)
    touched, turns, names, sizes = own or [now, [], [], []]
    if own:
        own[0] = now
    if op == "turn":
        turns = [*turns, seq][-MAX_TURNS:]
    elif op == "upload":
        if sum(sizes) + chunks > MAX_CHUNKS:
            return "too many chunks", None
        names, sizes = [*names, name], [*sizes, chunks]
    elif op == "remove":
        if name not in names:
            return "no such file", None
        k = len(names) - 1 - names[::-1].index(name)
        names, sizes = names[:k] + names[k + 1 :], sizes[:k] + sizes[k + 1 :]
    else:
        return "unknown", None
    held[conv] = [now, turns, names, sizes]
    if len(held) <= MAX_CONVS:
        return "kept", None
    oldest = min(held, key=lambda c: held[c][0])
    del held[oldest]
    return "kept", oldest


def taken(user, held: dict[str, list], batches: Iterable) -> Iterator:
    """The rows of OUT for a user's events; held is brought up to date."""
    import pandas as pd

    rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "seq"], kind="stable")
    out = []
    for conv, op, name, chunks, seq in rows[["conv", "op", "name", "chunks", "seq"]].itertuples(index=False, name=None):
        size = 0 if pd.isna(chunks) else max(0, int(chunks))
        verdict, evicted = step(held, (conv, op, None if pd.isna(name) else name, size, int(seq)))
        own = held.get(conv, [0, [], [], []])
        out.append((user, int(seq), conv, op, verdict, evicted, len(own[1]), len(own[2]), sum(own[3])))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"user": "int64", "seq": "int64", "turns": "int32", "files": "int32", "chunks": "int64"})


def kept_up(events: DataFrame) -> DataFrame:
    """The stream of verdicts on a stream of events. Events without user, conv, op or seq are left out."""
    from pyspark.sql.streaming import StatefulProcessor

    class Histories(StatefulProcessor):
        def init(self, handle) -> None:
            self.convs = handle.getMapState("convs", "conv string", HELD)

        def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803 - Spark's names
            before = {k[0]: [v[0], list(v[1]), list(v[2]), list(v[3])] for k, v in self.convs.iterator()}
            held = {k: list(v) for k, v in before.items()}
            yield from taken(key[0], held, rows)
            for conv in before.keys() - held.keys():
                self.convs.removeKey((conv,))
            for conv, own in held.items():
                if before.get(conv) != own:
                    self.convs.updateValue((conv,), tuple(own))

        def close(self) -> None:
            pass

    known = events.where("user IS NOT NULL AND conv IS NOT NULL AND op IS NOT NULL AND seq IS NOT NULL")
    return known.groupBy("user").transformWithStateInPandas(Histories(), OUT, "append", "none")


def run(events: DataFrame, out: str, checkpoint: str) -> None:
    """Run the stream to its present end; each batch's verdicts lie in a folder of their own below out, written again if the batch is run again."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        query = kept_up(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def verdicts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(OUT + ", batch long").parquet(out)


def as_events(rows: DataFrame) -> DataFrame:
    """The events table as turns, uploads and removals in 23 conversations of each of 40 users."""
    k = F.col("event_id")
    op = F.when(k % 4 == 1, "upload").when(k % 9 == 2, "remove").otherwise("turn")
    return rows.select(
        (F.col("user_id") % 40).alias("user"),
        F.concat(F.lit("c"), F.pmod(F.xxhash64("event_id"), F.lit(23)).cast("string")).alias("conv"),
        op.alias("op"),
        F.concat(F.lit("f"), (k % 5).cast("string")).alias("name"),
        (F.abs(F.col("value")) * 50).cast("long").alias("chunks"),
        F.col("ts").cast("timestamp").alias("at"),
        k.alias("seq"),
    )


@frame()
def history_kept(spark, d):
    """Verdicts of the stream of all events, read to its end."""
    from tessera.operators.index import shared_path

    path = shared_path(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    run(as_events(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")), f"{path}/out", f"{path}/state")
    return verdicts(spark, f"{path}/out").drop("batch")
