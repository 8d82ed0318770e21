"""Histories of users by a stream over several batches against a plain replay."""

import datetime as dt
import random

from tessera import registry
from tessera.streaming import history

D = "/root/testdata/sf0.001"


def replayed(events):
    """(user, seq) -> verdict, evicted, turns, files, chunks; convs are lists in order of touch, files pairs."""
    users, out = {}, {}
    for user, conv, op, name, chunks, seq in events:
        convs = users.setdefault(user, [])
        at = next((k for k, c in enumerate(convs) if c["id"] == conv), None)
        own = {"id": conv, "turns": [], "files": []} if at is None else convs.pop(at)
        had, verdict, gone = at is not None, "kept", None
        if op == "turn":
            own["turns"] = (own["turns"] + [seq])[-20:]
        elif op == "upload" and sum(n for _, n in own["files"]) + chunks > 3000:
            verdict = "too many chunks"
        elif op == "upload":
            own["files"].append((name, chunks))
        elif name in [n for n, _ in own["files"]]:
            own["files"].pop(max(k for k, f in enumerate(own["files"]) if f[0] == name))
        else:
            verdict = "no such file"
        if had or verdict == "kept":
            convs.append(own)
        if len(convs) > 10:
            gone = convs.pop(0)["id"]
        out[user, seq] = (verdict, gone, len(own["turns"]), len(own["files"]), sum(n for _, n in own["files"]))
    return out


def test_stream_over_batches_is_a_replay(spark, tmp_path):
    rng, t = random.Random(4), dt.datetime(2024, 1, 1)
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    events, seq = [], 0
    for batch in range(3):
        rows = []
        for _ in range(400):
            seq += 1
            rows.append((rng.choice([1, 1, 1, 2, 3]), f"c{rng.randrange(14)}", rng.choice(["turn", "turn", "upload", "remove"]), f"f{rng.randrange(4)}", rng.choice([0, 400, 1700, 3000, 3001]), t + dt.timedelta(seconds=seq // 3), seq))
        events += rows
        shuffled = rng.sample(rows, len(rows)) + ([(None, "c1", "turn", None, None, t, -1), (1, None, "turn", None, None, t, -2)] if batch == 1 else [])
        spark.createDataFrame(shuffled, history.EVENTS).repartition(3).coalesce(1).write.mode("append").parquet(src)
        history.run(spark.readStream.schema(history.EVENTS).parquet(src), out, state)
    want = replayed([(u, c, op, n, k, s) for u, c, op, n, k, _, s in events])
    got = history.verdicts(spark, out).collect()
    assert len(got) == len(want) == 1200
    assert {(r["user"], r["seq"]): (r["verdict"], r["evicted"], r["turns"], r["files"], r["chunks"]) for r in got} == want
    assert {v[0] for v in want.values()} == {"kept", "too many chunks", "no such file"} and any(v[1] for v in want.values())


def test_query_is_a_replay(spark):
    rows = history.as_events(spark.read.parquet(f"{D}/events.parquet")).orderBy("at", "seq").collect()
    want = replayed([(r["user"], r["conv"], r["op"], r["name"], r["chunks"], r["seq"]) for r in rows])
    got = registry.queries()["history_kept"](spark, D).collect()
    assert len(got) == len(rows)
    assert {(r["user"], r["seq"]): (r["verdict"], r["evicted"], r["turns"], r["files"], r["chunks"]) for r in got} == want
