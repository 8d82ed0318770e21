"""Batches of documents and packed key requests.

Exploding every line or n-gram of a corpus into a row of its own makes more shuffle than text. Here documents are dealt
by a hash into batches of bounded text; a batch names each key it holds once, packed by the key's shard. A shard
gathers its keys from all batches, and answers each batch. A key in a third of all documents is so one entry a batch,
whatever its number of documents. Batches and shards grow in number, not in size, with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 6 << 20
SHARD_BYTES = 16 << 20


def dealt(docs: DataFrame, size: int, column: str, *by: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """docs with its batch number in column, by a hash of the columns by: with the text among them, null or repeated ids spread out."""
    n = max(1, -(-size // batch_bytes))
    return docs.withColumn(column, F.pmod(F.xxhash64(*(F.col(x) for x in by)), F.lit(n)).cast("int"))


def shards(size: int, shard_bytes: int = SHARD_BYTES) -> int:
    return max(1, -(-size // shard_bytes))


def texts(batch: pa.Table, column: str) -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding."""
    return batch.column(column).cast(pa.large_binary()).to_pylist()


SLICE_ROWS = 256


def slices(batches, rows: int = SLICE_ROWS):
    """Batches in slices of few rows: what a task makes of them stays small, however long the texts are."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def planes(sorted_keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as Rice-coded differences: the low bits, which are as good as random, bit plane by bit plane, and the rest in unary.

    Bytes: number of low bits, number of keys (8), low planes (each ceil(keys / 8)), unary bits: for each key its upper part in zeros, then a one.
    """
    n = len(sorted_keys)
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    mean = int(sorted_keys[-1] - sorted_keys[0]) // n if n else 0
    low = max(0, mean.bit_length() - 1)
    first = gaps[:1].tolist()  # the first key stands whole: a shard's keys start high
    rest = gaps[1:]
    upper = (rest >> np.uint64(low)).astype(np.int64)
    ends = np.cumsum(upper + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    whole, part = divmod(low, 8)
    data = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(len(rest), 8)[:, :whole].T).tobytes()
    for k in range(8 * whole, 8 * whole + part):
        data += np.packbits(((rest >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).tobytes()
    return bytes([low]) + n.to_bytes(8, "little") + b"".join(x.to_bytes(8, "little") for x in first) + data + np.packbits(unary).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    low, n = data[0], int.from_bytes(data[1:9], "little")
    if not n:
        return np.zeros(0, np.uint64)
    first, at, m = int.from_bytes(data[9:17], "little"), 17, n - 1
    whole, part = divmod(low, 8)
    rest = np.zeros((m, 8), np.uint8)
    rest[:, :whole] = np.frombuffer(data, np.uint8, m * whole, at).reshape(whole, m).T
    rest = rest.view("<u8").ravel() if m else np.zeros(0, np.uint64)
    at += m * whole
    for k in range(8 * whole, 8 * whole + part):
        each = -(-m // 8)
        rest |= np.unpackbits(np.frombuffer(data, np.uint8, each, at), count=m).astype(np.uint64) << np.uint64(k)
        at += each
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=at)))[:m]
    rest = rest | (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    return np.cumsum(np.concatenate([np.array([first], np.uint64), rest]), dtype=np.uint64)
