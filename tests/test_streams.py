"""Streams from files, to their end and batch by batch."""

import datetime as dt

from tessera import registry
from tessera.streaming import windows

D = "/root/testdata/sf0.001"


def accepted(rows):
    last, out = {}, set()
    for at, event, user, kind in sorted(rows):
        if (user, kind) not in last or (at - last[user, kind]).total_seconds() >= 600:
            last[user, kind] = at
            out.add(event)
    return out


def test_accepted_by_stream_and_batch(spark):
    rows = [(r["ts"], r["event_id"], r["user_id"], r["event_type"]) for r in spark.read.parquet(f"{D}/events.parquet").collect()]
    want = accepted(rows)
    for name in ("streamed_accepted", "accepted_events"):
        got = [r["event_id"] for r in registry.queries()[name](spark, D).collect()]
        assert len(got) == len(want) and set(got) == want


def test_counts_by_stream(spark):
    got = {(r["hour"], r["event_type"]): r["n"] for r in registry.queries()["streamed_counts"](spark, D).collect()}
    want = {(r["hour"], r["event_type"]): r["n"] for r in registry.queries()["tumbling_counts"](spark, D).collect()}
    assert got == want


def test_settled_sessions_over_two_batches(spark, tmp_path):
    """A session that goes on in the next file is one; it comes out once the watermark has passed its end."""
    t = dt.datetime(2024, 1, 1, 12)
    at = lambda m: t + dt.timedelta(minutes=m)
    schema = "ts timestamp, user_id long, event_type string, event_id long"
    src, out = str(tmp_path / "src"), []
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(at(0), 1, "a", 1), (at(30), 1, "a", 2), (at(5), 2, "a", 3)])
    stream = windows.stream_settled(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))

    def run():
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: out.extend((r["user_id"], r["n"]) for r in b.select("user_id", "n").collect())).start()
        q.awaitTermination()

    run()
    assert out == []
    put([(at(80), 1, "a", 4)])
    run()
    put([(at(600), 3, "b", 5)])
    run()
    assert sorted(out) == [(1, 3), (2, 1)]
