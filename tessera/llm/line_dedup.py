"""Line dedup over a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z in lower case. A key of at least min_chars code points that
at least two documents hold loses all its lines but those in the smallest doc_id that holds it.

First the index is built and stored: each shard of line hashes has a minimal perfect hash over its distinct hashes (a bit vector
with ranks), which indexes compact arrays: fingerprint of 32 bits, number of documents up to 255, first document. Hashes that
share the 64 bits that the perfect hash is built on stand in a list apart, so that no line is taken for another. Then the
documents' hashes probe the stored arrays of their shard; the shards answer with the repeated ones.

Nulls: a null text is one empty line and stays null; a null doc_id counts as one document after all others. Rows that
repeat a doc_id are one document. An empty table gives an empty result. Other columns pass through unchanged, also those named as
the counts: these then get a longer name.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LAST_ID, SPACE_BYTES, fresh, store, text_size
from tessera.llm.packed import dealt, mixed, shards, slices, texts

MIN_CHARS = 10
#: Slots a key at each level of the perfect hash.
SLOTS_A_KEY = 1.5


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1: keys alone in their slot settle at a level, the others go on to the next.

    A slot's rank among the settled slots of all levels is the key's index; a level keeps a bit a slot and a rank for 64 slots.
    Keys that were not in the set get any index (or -1), so a fingerprint has to tell them apart.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.levels = levels  # slots, settled slots as bits of words, rank of each word's first slot

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rank = [], 0
        while len(keys):
            slots = max(64, int(SLOTS_A_KEY * len(keys)) + 63 & ~63)
            at = cls._slot(keys, len(levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            held = np.bitwise_count(words).astype(np.int64)
            levels.append((slots, words, (rank + np.cumsum(held) - held).astype("<u4")))
            rank += int(held.sum())
            keys = keys[~alone[at]]
        return cls(levels)

    @property
    def size(self) -> int:
        return sum(int(np.bitwise_count(words).sum()) for _, words, _ in self.levels)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, slots: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))) % np.uint64(slots)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (slots, words, ranks) in enumerate(self.levels):
            at = self._slot(keys[left], level, slots)
            word, bit = words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            found[left[hit]] = ranks[at[hit] >> 6].astype(np.int64) + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            left = left[~hit]
            if not len(left):
                break
        return found

    def packed(self) -> bytes:
        return b"".join(struct.pack("<Q", slots) + words.tobytes() + ranks.tobytes() for slots, words, ranks in self.levels)

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(data):
            (slots,) = struct.unpack_from("<Q", data, at)
            n = slots // 64
            levels.append((slots, np.frombuffer(data, "<u8", n, at + 8), np.frombuffer(data, "<u4", n, at + 8 + 8 * n)))
            at += 8 + 12 * n
        return cls(levels)


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line; None if it is too short to count."""
    key = line.strip(SPACE_BYTES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key.lower()  # bytes: A-Z alone


def _line_digests(data: bytes | None, min_chars: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(key) for key in {line_key(x, min_chars) for x in set(data.split(b"\n"))} - {None}} if data else set()


def _by_shard(hashes: np.ndarray, n_shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shards that hashes (rows of two 64-bit halves) need, and the rows of each."""
    shard = (hashes[:, 0] >> np.uint64(32)) % np.uint64(n_shards)
    order = np.argsort(shard, kind="stable")
    names, starts = np.unique(shard[order], return_index=True)
    return names.astype(np.int32), np.split(order, starts[1:])[: len(names)]


def _told(doc_id: str, text: str, n_shards: int, min_chars: int):
    def told(batches):
        """For the index: each distinct line hash of a batch, its number of documents, and the first and the last of them."""
        for batch in slices(batches, 2048):
            batch = pa.Table.from_batches([batch])
            ids = np.array([LAST_ID if x is None else x for x in batch.column(doc_id).to_pylist()], np.int64)
            found = [_line_digests(x, min_chars) for x in texts(batch, text)]
            hashes = np.frombuffer(b"".join(x for own in found for x in own), "<u8").reshape(-1, 2)
            holder = np.repeat(ids, [len(x) for x in found])
            hashes, count, first, last = _totals(hashes, np.ones(len(holder), np.int64), holder, holder)
            names, cuts = _by_shard(hashes, n_shards)
            column = lambda x, t, k=pa.binary(): pa.array([np.ascontiguousarray(x[c].astype(t)).tobytes() for c in cuts], k)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(names, pa.int32()), "hashes": column(hashes, "<u8"), "documents": column(count, "u1"), "first": column(first, "<i8"), "last": column(last, "<i8")})

    return told


def _totals(hashes: np.ndarray, count: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with their number of documents (1 if first and last are the same one, 255 if more), first and last document."""
    if not len(hashes):
        return hashes, count, first, last
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    own = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
    low, high = np.minimum.reduceat(first[order], starts), np.maximum.reduceat(last[order], starts)
    number = np.where(low == high, 1, np.clip(np.add.reduceat(count[order], starts), 2, 255))
    return own[starts], number, low, high


def _index(told: pa.Table) -> pa.Table:
    """The stored arrays of one shard."""
    read = lambda name, t: np.frombuffer(b"".join(told.column(name).to_pylist()), t)
    hashes, count, first, _ = _totals(read("hashes", "<u8").reshape(-1, 2), read("documents", "u1").astype(np.int64), read("first", "<i8"), read("last", "<i8"))
    keys = hashes[:, 0]
    same = np.concatenate([keys[1:] == keys[:-1], [False]]) if len(keys) else np.zeros(0, bool)
    apart = same | np.concatenate([[False], same[:-1]])[: len(same)]
    table = PerfectHash.of(keys[~apart])
    at = table.index(keys[~apart])
    arrays = [np.zeros(len(at), t) for t in ("<u4", "u1", "<i8")]
    for own, values in zip(arrays, (hashes[:, 1] & np.uint64(0xFFFFFFFF), count, first), strict=True):
        own[at] = values[~apart]
    odd = np.concatenate([hashes[apart], count[apart, None].astype("<u8"), first[apart, None].astype("<i8").view("<u8")], axis=1).astype("<u8")
    row = {"shard": [told.column("shard")[0].as_py()], "hash": [table.packed()], "fingerprint": [arrays[0].tobytes()], "documents": [arrays[1].tobytes()], "first": [arrays[2].tobytes()], "apart": [odd.tobytes()]}
    return pa.table({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in row.items()})


def _requests(batch_at: str, text: str, n_shards: int, min_chars: int):
    def requests(batch: pa.Table) -> pa.Table:
        """The distinct line hashes of a batch of documents, a row a shard."""
        found = sorted(set().union(*(_line_digests(x, min_chars) for x in texts(batch, text))))
        hashes = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        names, cuts = _by_shard(hashes, n_shards)
        return pa.table(
            {
                "shard": pa.array(names, pa.int32()),
                "batch": pa.array([batch.column(batch_at)[0].as_py()] * len(names), pa.int32()),
                "hashes": pa.array([hashes[c].tobytes() for c in cuts], pa.binary()),
            }
        )

    return requests


def _probe(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Each batch's repeated lines and their first documents, from the shard's arrays."""
    out: dict[str, list] = {"batch": [], "hashes": [], "first": []}
    if len(asked):
        row = {k: v[0] for k, v in index.to_pydict().items()}
        table = PerfectHash.unpacked(row["hash"])
        fingerprint, count, first = np.frombuffer(row["fingerprint"], "<u4"), np.frombuffer(row["documents"], "u1"), np.frombuffer(row["first"], "<i8")
        odd = {bytes(x[:16]): (int.from_bytes(x[16:24], "little"), int.from_bytes(x[24:], "little", signed=True)) for x in (row["apart"][k : k + 32] for k in range(0, len(row["apart"]), 32))}
        for number, own in zip(asked.column("batch").to_pylist(), asked.column("hashes").to_pylist(), strict=True):
            hashes = np.frombuffer(own, "<u8").reshape(-1, 2)
            at = table.index(hashes[:, 0])
            known = at >= 0
            known[known] = fingerprint[at[known]] == hashes[known, 1] & np.uint64(0xFFFFFFFF)
            hit = known.copy()
            hit[known] = count[at[known]] > 1
            told = [hashes[hit].tobytes()]
            holders = [first[at[hit]].tobytes()]
            for k in np.flatnonzero(~known).tolist() if odd else []:
                documents, holder = odd.get(hashes[k].tobytes(), (0, 0))
                if documents > 1:
                    told.append(hashes[k].tobytes()), holders.append(struct.pack("<q", holder))
            if any(told):
                out["batch"].append(number), out["hashes"].append(b"".join(told)), out["first"].append(b"".join(holders))
    return pa.table({"batch": pa.array(out["batch"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary()), "first": pa.array(out["first"], pa.binary())})


def _applied(columns: list[str], doc_id: str, text: str, min_chars: int, names: tuple[str, str]):
    def applied(batch: pa.Table, answers: pa.Table) -> pa.Table:
        first: dict[bytes, int] = {}
        for packed, holders in zip(answers.column("hashes").to_pylist(), answers.column("first").to_pylist(), strict=True):
            first.update(zip((packed[k : k + 16] for k in range(0, len(packed), 16)), np.frombuffer(holders, "<i8").tolist(), strict=True))
        kept, counts, dropped = [], [], []
        for own, data in zip(batch.column(doc_id).to_pylist(), texts(batch, text), strict=True):
            lines = (data or b"").split(b"\n")
            own = LAST_ID if own is None else own
            stay = []
            for line in lines:
                key = line_key(line, min_chars) if first else None
                if key is None or first.get(xxhash.xxh3_128_digest(key), own) == own:
                    stay.append(line)
            kept.append(data if len(stay) == len(lines) else b"\n".join(stay))
            counts.append(len(lines))
            dropped.append(len(lines) - len(stay))
        out = batch.select(columns)
        out = out.set_column(columns.index(text), text, pa.array(kept, pa.binary()).cast(pa.string()))
        return out.append_column(names[0], pa.array(counts, pa.int64())).append_column(names[1], pa.array(dropped, pa.int64()))

    return applied


def line_index(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The stored index: a row a shard (shard, hash, fingerprint, documents, first, apart)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    told = own.mapInArrow(_told("doc_id", "text", n_shards, min_chars), "shard int, hashes binary, documents binary, first binary, last binary")
    return store(told.groupBy("shard").applyInArrow(_index, "shard int, hash binary, fingerprint binary, documents binary, first binary, apart binary"), "lines")


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the count columns: n_lines and n_dropped, longer where docs has these."""
    return fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated lines cut from text, and the columns of count_names: lines before, and lines dropped."""
    _, size = text_size(docs, text)
    n_shards = shards(size)
    index = line_index(docs, n_shards, doc_id, text, min_chars)
    at = fresh("batch_no", docs.columns)
    rows = dealt(docs, size, at, doc_id, text)
    groups = rows.groupBy(at)
    asked = groups.applyInArrow(_requests(at, text, n_shards, min_chars), "shard int, batch int, hashes binary")
    answers = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "batch int, hashes binary, first binary")
    names = count_names(docs)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names)])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return groups.cogroup(answers.groupBy("batch")).applyInArrow(_applied(docs.columns, doc_id, text, min_chars, names), schema)


def query(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
held AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, held.k IS NOT NULL AND doc_id <> first_doc AS gone FROM keyed LEFT JOIN held ON keyed.k = held.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
