"""Sharding by histogram sort, under the law `bytes`. DataFrame operations only.

Documents lie in the order of (hash of the text, doc_id), equal texts side by side; shards are ranges of that order of about
equal bytes. Splitters are found without sorting: count the exact bytes below candidate boundaries over all partitions,
keep the interval in which a shard's share of the bytes is reached, and probe that interval more finely, until a boundary
between groups of equal texts lies within tolerance of the share. Where a single group is too large for that, its
doc_ids are probed in the same way, so that a group of any size is split and the others stay whole. Then whole rows move once,
by the splitters found, and are written as files in a folder for each shard.

A shard is numbered in pieces, each by one task: rows of equal leading bits of the hash, and where these are too many or too large, as in a large group of equal texts, parts of them by a hash
of the doc_id. Pieces grow in number with the table and stay small; they are rows of a table, counted and summed by Spark, never known to the driver. Slots are the piece's start and the place in it.
The query's sizes and checksums are those of the rows in the shards' files.

Nulls: a null text is no bytes and lies with the empty texts apart from them by hash; a null doc_id lies before all others. Rows equal in text
and doc_id lie side by side, in one piece. An empty table gives an empty result. Extra columns move along.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, shared_dir, store

SHARDS = 24
#: Of a shard's share of the bytes.
TOLERANCE = 0.01
#: Rows and bytes of a piece, about; a single group of rows equal in text and doc_id may be larger.
PIECE_ROWS, PIECE_BYTES = 500_000, 128 << 20
#: Pieces up to this number are broadcast (about 40 bytes each), more are joined by shuffle.
BROADCAST_PIECES = 500_000
#: Bits probed at once: first, then each round.
FIRST_BITS, NEXT_BITS = 10, 6
LOWEST = -(1 << 63)


def _prefix(column: str, bits: int):
    return F.shiftright(F.col(f"`{column}`"), 64 - bits)


def _start(prefix: int, bits: int) -> int:
    """The least signed 64-bit number with this prefix."""
    return prefix << (64 - bits)


def _refine(rows: DataFrame, column: str, weight, targets: dict[int, list[float]], ahead: dict[int, float], slack: float, bits: int, group: str | None = None) -> dict[int, list[tuple[int, float, float]]]:
    """For each group and each of its targets (ascending): (boundary, weight below it, weight of the one value at it that holds the target, or 0).

    All groups are probed in the same job, a round each NEXT_BITS. Weights are exact sums over all rows; the driver sees the
    counts of the probed sub-intervals alone, bounded by targets * 2 ** NEXT_BITS (first round: groups * 2 ** bits). ahead: weight before a group.
    """
    found: dict[tuple[int, int], tuple[int, float, float]] = {}
    todo = {(g, k): (None, ahead[g]) for g, own in targets.items() for k in range(len(own))}
    name = F.col(group) if group else F.lit(0).cast("long")
    last, then = 0, bits
    while todo:
        rows = rows.where(name.isin(sorted({g for g, _ in todo}))) if group else rows
        asked = sorted({p for p, _ in todo.values() if p is not None})
        own = rows.where(_prefix(column, last).isin(asked)) if asked else rows
        sums: dict[int, list[tuple[int, float]]] = {}
        for r in own.groupBy(name.alias("g"), _prefix(column, then).alias("p")).agg(F.sum(weight).alias("w")).collect():
            sums.setdefault(r["g"], []).append((r["p"], float(r["w"])))
        for own in sums.values():
            own.sort()
        left = {}
        for (g, k), (prefix, below) in todo.items():
            target, p, w = targets[g][k], 0, 0.0
            for p, w in sums.get(g, []):
                if prefix is not None and p >> (then - last) != prefix:
                    continue
                if below + w >= target:
                    break
                below += w
            else:  # the target lies at the end
                w = 0.0
            if below >= target - slack:
                found[g, k] = (_start(p, then), below, 0.0)
            elif below + w <= target + slack and _start(p, then) + (1 << (64 - then)) < 1 << 63:
                found[g, k] = (_start(p, then) + (1 << (64 - then)), below + w, 0.0)
            elif then == 64:
                found[g, k] = (p, below, w)
            else:
                left[g, k] = (p, below)
        todo, last, then = left, then, min(64, then + NEXT_BITS)
    return {g: [found[g, k] for k in range(len(own))] for g, own in targets.items()}


def splitters(slim: DataFrame, weight, total: float, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """parts - 1 keys (hash, doc_id): part k holds the keys from splitter k - 1 on and below splitter k."""
    share = total / parts
    targets = [share * k for k in range(1, parts)]
    slack = share * tolerance
    found = _refine(slim, "h", weight, {0: targets}, {0: 0.0}, slack, FIRST_BITS)[0]
    out: list[tuple[int, int]] = []
    inside: dict[int, list[int]] = {}
    for k, (at, below, held) in enumerate(found):
        out.append((at, LOWEST))
        if held:
            inside.setdefault(at, []).append(k)
    if inside:  # groups of equal texts that hold splitters: at most parts of them
        groups = slim.where(F.col("h").isin(sorted(inside)))
        span = {r["h"]: (r["low"], r["high"]) for r in groups.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}
        lone = {h for h, (low, high) in span.items() if low == high}
        several = {h: own for h, own in inside.items() if h not in lone}
        # Bits that the doc_ids of every group share need no probe.
        shared = min((0 if (span[h][0] < 0) != (span[h][1] < 0) else 64 - (span[h][0] ^ span[h][1]).bit_length() for h in several), default=0)
        deep = _refine(groups, "doc_id", weight, {h: [targets[k] for k in own] for h, own in several.items()}, {h: found[own[0]][1] for h, own in several.items()}, slack, min(64, shared + FIRST_BITS), "h") if several else {}
        for h, own in inside.items():
            for k, (at, below, held) in zip(own, deep.get(h) or [(span[h][0], found[own[0]][1], found[own[0]][2])] * len(own), strict=True):
                # The splitter goes to the nearer side of a single key.
                out[k] = (h, at) if not held or targets[k] - below <= below + held - targets[k] or at == LOWEST + (1 << 64) - 1 else (h, at + 1)
    return sorted(out)


def _below(keys: list[tuple[int, int]], h, doc_id):
    """Number of keys that a row's key reaches, for the splitters of shards: by halves, so that a row compares with few of them."""
    if not keys:
        return F.lit(0)
    mid = len(keys) // 2
    at = F.struct(F.lit(keys[mid][0]).cast("long").alias("h"), F.lit(keys[mid][1]).cast("long").alias("d"))
    reached = (h > at["h"]) | ((h == at["h"]) & (doc_id >= at["d"]))
    return F.when(reached, _below(keys[mid + 1 :], h, doc_id) + (mid + 1)).otherwise(_below(keys[:mid], h, doc_id))


def _size(text):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def sharded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, str]:
    """The rows of docs with the columns shard and slot (longer names where docs has these), read from the shards' files, and their folder."""
    t, key, h = F.col(text), F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)), F.xxhash64(F.col(text))
    slim = store(docs.select(key.alias("doc_id"), _size(t).alias("size"), h.alias("h")), "sizes")
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    by_bytes = splitters(slim, F.col("size"), float(total), shards, tolerance) if rows else []
    # Bits of the hash that cut the table into twice the pieces it needs, so that few of them need parts.
    bits = max(1, math.ceil(math.log2(max(2, 2 * rows / PIECE_ROWS, 2 * total / PIECE_BYTES))))
    of = lambda h, key: {shard_at: _below(by_bytes, F.col(f"`{h}`"), F.col(f"`{key}`")), cut_at: _prefix(h, bits)}
    names = docs.columns
    shard_at, slot_at, cut_at, part_at, parts_at, start_at, h_at, key_at = (fresh(x, names) for x in ("shard", "slot", "hash_cut", "hash_part", "hash_parts", "piece_start", "text_hash", "order_id"))
    keyed = slim.withColumns(of("h", "doc_id"))
    need = F.ceil(F.greatest(F.count(F.lit(1)) / PIECE_ROWS, F.sum("size") / PIECE_BYTES)).cast("int")
    parts = store(keyed.groupBy(shard_at, cut_at).agg(need.alias(parts_at)), "parts")
    n_pieces = parts.count()
    sized = lambda x: F.broadcast(x) if n_pieces <= BROADCAST_PIECES else x
    part = lambda h, key: F.when(F.col(parts_at) > 1, F.pmod(F.xxhash64(h, key), F.col(parts_at))).otherwise(0).cast("int")
    counts = keyed.join(sized(parts), [shard_at, cut_at]).groupBy(shard_at, cut_at, part("h", "doc_id").alias(part_at)).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard_at).orderBy(cut_at, part_at)
    starts = store(counts.select(shard_at, cut_at, part_at, (F.sum("n").over(before) - F.col("n")).alias(start_at)), "pieces")
    placed = docs.withColumns({h_at: h, key_at: key}).withColumns(of(h_at, key_at)).join(sized(parts), [shard_at, cut_at]).withColumn(part_at, part(h_at, key_at))
    number = F.row_number().over(Window.partitionBy(shard_at, cut_at, part_at).orderBy(h_at, key_at))
    laid = placed.withColumn(slot_at, number - 1).join(sized(starts), [shard_at, cut_at, part_at])
    laid = laid.select(*(F.col(f"`{x}`") for x in names), (F.col(start_at) + F.col(slot_at)).cast("long").alias(slot_at), F.col(shard_at).cast("int").alias(shard_at))
    path = f"{shared_dir(docs.sparkSession)}/tessera/shards-{uuid.uuid4().hex}"
    laid.write.partitionBy(shard_at).parquet(path)
    return docs.sparkSession.read.schema(laid.schema).parquet(path), path


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row in the shards' files."""
    rows, _ = sharded(docs)
    t = F.col("text")
    crc = F.crc32(F.coalesce(t, F.lit("")).cast("binary"))
    shard, slot = (F.col(fresh(x, docs.columns)) for x in ("shard", "slot"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), _size(t).alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
