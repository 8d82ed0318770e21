"""Corpus operators that do the whole job."""

import collections

from tessera.llm import sharding


def test_whole_rows_lie_in_the_files_of_their_shard(spark):
    rows = [(k, None if k == 7 else f"text {k % 900} " * (k % 40), f"src{k % 3}", k) for k in range(2000)] + [(5, "text 5 " * 5, "src2", 5), (None, "no id", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard long").repartition(3)
    got, path = sharding.sharded(docs)
    assert got.columns == ["doc_id", "text", "source", "shard", "slot", "shard_"]
    assert collections.Counter(tuple(r)[:4] for r in got.collect()) == collections.Counter(rows)
    want = collections.Counter((r["shard_"], r["slot"], r["text"]) for r in got.collect())
    assert len(want) == len(rows)
    for k in range(sharding.SHARDS):
        own = spark.read.parquet(f"{path}/shard_={k}").collect()
        assert own and sorted(r["slot"] for r in own) == list(range(len(own)))
        assert all((k, r["slot"], r["text"]) in want for r in own)
    digests = {(r["shard"], r["slot"]): (r["doc_id"], r["size"]) for r in sharding.query(docs).collect()}
    assert digests == {(r["shard_"], r["slot"]): (r["doc_id"], len((r["text"] or "").encode()) + 8) for r in got.collect()}


def test_pieces_of_a_hot_group_are_small_and_slots_gapless(spark, monkeypatch):
    """A third of the rows are one text, a third of all rows have no id, and columns clash with the operator's own."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 100)
    seen = []
    monkeypatch.setattr(sharding, "store", lambda df, what, put=sharding.store: seen.append((what, put(df, what))) or seen[-1][1])
    rows = [(None if k % 3 == 0 else k, "the same" if k % 3 == 1 else f"text {k}", k, k) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_start long, hash_parts long").repartition(5)
    for limit in (500_000, 0):  # broadcast and joined by shuffle
        monkeypatch.setattr(sharding, "BROADCAST_PIECES", limit)
        got, _ = sharding.sharded(docs)
        out = got.collect()
        assert collections.Counter(tuple(r)[:4] for r in out) == collections.Counter(rows)
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r["slot"])
        assert len(by) == 24 and all(sorted(x) == list(range(len(x))) for x in by.values())
    parts = dict(seen)["parts"].collect()
    assert sum(r["hash_parts_"] for r in parts) >= 60 and max(r["hash_parts_"] for r in parts) > 1


def test_halving_counts_the_keys_reached(spark):
    keys = sorted((h, d) for h in (-9, 0, 4) for d in (sharding.LOWEST, 3, 8))
    rows = [(h, d) for h in (-10, -9, 1, 4, 5) for d in (sharding.LOWEST, 2, 3, 9)]
    df = spark.createDataFrame(rows, "h long, d long")
    for r in df.withColumn("n", sharding._below(keys, df["h"], df["d"])).collect():
        assert r["n"] == sum(k <= (r["h"], r["d"]) for k in keys)


def test_splitters_are_within_tolerance_of_brute_force(spark):
    rows = [(k, (k * 7919) % 1000003 - 500000 if k % 4 else 77, 1 + k % 90) for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, h long, size long")
    total = sum(r[2] for r in rows)
    cuts = sharding.splitters(df, df["size"], float(total), 9, 0.01)
    assert len(cuts) == 8
    for k, cut in enumerate(cuts, 1):
        below = sum(s for i, h, s in rows if (h, i) < cut)
        assert abs(below - total * k / 9) <= total / 9 * 0.01 + 91
