"""Token ids in patched frame-of-reference blocks.

A segment holds consecutive documents in ascending doc_id. Its ids are cut into blocks of 128: the block's minimum is subtracted,
the rest packed at the width that a given share of them needs (a percentile), and the others' upper bits stand in exception lists. An index
holds where each block starts, so that any range of ids decodes without what stands before it.

Bytes of a segment, all little-endian:
    "TPFR", u16 version, u16 block length, u32 documents, u64 ids, u32 blocks
    documents x (i64 doc_id, u64 ids before it in the segment)
    blocks x (u32 start in the block area, u32 minimum, u8 width, u8 exceptions)
    block area: packed low bits (16 * width bytes), then the exceptions: u8 place each, u32 upper bits each
Segments are rows (part, segment, first_id, last_id, n_ids, payload) of Parquet files, so that Spark's committers and readers carry them to
and from any store. A null doc_id stands as the largest 64-bit integer, after all others.

Nulls: a null or empty text is the end id alone. Rows that repeat a doc_id follow each other by text. An empty table gives no segments.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LAST_ID, shared_dir, text_size

BLOCK, PERCENTILE, END_ID = 128, 90, 1
SEGMENT_IDS = 1 << 18
#: Bytes of text in a part: small ones keep all cores busy; of a large corpus the parts grow, not their number. A part streams, and its sort spills.
PART_BYTES, MOST_PARTS = 8 << 20, 20_000
_HEAD = struct.Struct("<4sHHIQI")


# Blocks


#: Values packed or unpacked at once: rows of bits that stay in the cache.
ROWS = 256


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low bits of rows of BLOCK values, end to end."""
    out = np.zeros((len(values), BLOCK * width // 8), np.uint8)
    for k in range(0, len(values) if width else 0, ROWS):
        bits = np.unpackbits(values[k : k + ROWS].astype("<u4").view(np.uint8).reshape(-1, BLOCK, 4)[:, :, : (width + 7) // 8], axis=2, bitorder="little")
        out[k : k + ROWS] = np.packbits(bits[:, :, :width].reshape(len(bits), -1), axis=1, bitorder="little")
    return out


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values from their packed bits."""
    out = np.zeros((len(data), BLOCK), "<u4")
    whole = (width + 7) // 8
    for k in range(0, len(data), ROWS):
        bits = np.unpackbits(data[k : k + ROWS], axis=1, bitorder="little").reshape(-1, BLOCK, width)
        out[k : k + ROWS].view(np.uint8).reshape(-1, BLOCK, 4)[:, :, :whole] = np.packbits(bits, axis=2, bitorder="little")
    return out


def encode(ids: np.ndarray, doc_ids: np.ndarray, before: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """A segment of ids; before: the number of ids ahead of each document."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    place = min(BLOCK - 1, BLOCK * percentile // 100)
    at = np.partition(rest, place, axis=1)[:, place] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    # An exception may not cost more than the bits it saves.
    over = (rest >> np.minimum(width, 31)[:, None].astype(np.uint32)) * (width < 32)[:, None]
    patched = over > 0
    number = patched.sum(axis=1)
    cuts = np.cumsum(number) - number
    block, place = np.nonzero(patched)
    places, uppers = place.astype(np.uint8).tobytes(), over[block, place].astype("<u4").tobytes()
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        data = _packed(rest[own], w)
        packed, each = data.tobytes(), data.shape[1]
        for k, (b, c, m) in enumerate(zip(own.tolist(), cuts[own].tolist(), number[own].tolist(), strict=True)):
            parts[b] = packed[k * each : k * each + each] + places[c : c + m] + uppers[4 * c : 4 * (c + m)]
    starts = np.cumsum([0, *map(len, parts)])[:-1] if blocks else np.zeros(0, np.int64)
    index = np.zeros(blocks, [("start", "<u4"), ("low", "<u4"), ("width", "u1"), ("over", "u1")])
    index["start"], index["low"], index["width"], index["over"] = starts, low, width, number
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("before", "<u8")])
    docs["id"], docs["before"] = doc_ids, before
    return _HEAD.pack(b"TPFR", 1, BLOCK, len(docs), n, blocks) + docs.tobytes() + index.tobytes() + b"".join(parts)


class Segment:
    def __init__(self, payload: bytes):
        magic, version, block, n_docs, self.n_ids, blocks = _HEAD.unpack_from(payload)
        if magic != b"TPFR" or version != 1 or block != BLOCK:
            raise ValueError("not a segment of this format")
        at = _HEAD.size
        self.docs = np.frombuffer(payload, [("id", "<i8"), ("before", "<u8")], n_docs, at)
        at += self.docs.nbytes
        self.index = np.frombuffer(payload, [("start", "<u4"), ("low", "<u4"), ("width", "u1"), ("over", "u1")], blocks, at)
        self.area, self.data = at + self.index.nbytes, np.frombuffer(payload, np.uint8)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids first..last (excluded), from the blocks that hold them alone."""
        last = self.n_ids if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-last // BLOCK)
        index = self.index[a:b]
        out = np.zeros((b - a, BLOCK), np.uint32)
        for w in np.unique(index["width"]).tolist():
            own = np.flatnonzero(index["width"] == w)
            if w:
                where = self.area + index["start"][own].astype(np.int64)[:, None] + np.arange(BLOCK * w // 8)
                out[own] = _unpacked(self.data[where], w)
        some = np.flatnonzero(index["over"])
        number, width = index["over"][some].astype(np.int64), index["width"][some].astype(np.int64)
        at = np.repeat(self.area + index["start"][some].astype(np.int64) + BLOCK * width // 8, number)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
        upper = self.data[(at + np.repeat(number, number) + 4 * turn)[:, None] + np.arange(4)].view("<u4").ravel()
        out[np.repeat(some, number), self.data[at + turn]] |= upper << np.repeat(width, number).astype(np.uint32)
        out += index["low"][:, None]
        return out.ravel()[first - a * BLOCK : last - a * BLOCK]


# Tokenizing


#: A text without these characters and without the opening of a special token is parted here as the vocabulary's normalizers and pre-tokenizer would.
_ODD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]|<\|")
#: The vocabulary's own pattern over those characters in lower case; \0 parts texts, and white space is passed over.
_PIECES = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s\x00a-zß-öø-ÿ0-9]+")


_PLAIN = bytes([*range(9, 14), *range(32, 127), *(x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))])


def _all_plain(whole: str, closings: int) -> bool:
    """Whether texts that a \\0 each closes hold no odd character, by one fast pass."""
    try:
        rest = whole.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False
    return len(rest) == closings and "<|" not in whole and rest.count(0) == closings


def _laid(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists end to end, their sizes and where each starts."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes, np.cumsum(sizes) - sizes


def _spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at, end to end, and where each ends."""
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]))], ends


class Numbers(dict):
    """Numbers of keys in the order in which they were first asked for; new: the keys since it was last emptied."""

    def __init__(self, count: int = 0):
        super().__init__()
        self.count, self.new = count, []

    def __missing__(self, key):
        self[key] = at = self.count
        self.count += 1
        self.new.append(key)
        return at

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


#: The normalizer and the pre-tokenizer of the one vocabulary whose texts may be parted here, as the library states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A vocabulary with exactly the normalizer and pre-tokenizer above, whose added tokens all open with "<|", drops white space and never joins what
    it parts, so the ids of a text are those of its pieces in turn. A plain text is parted into pieces here, and the library's model
    tokenizes each distinct piece; of other texts the library encodes each distinct run of non-space characters. Held pieces and
    runs are forgotten beyond a bound of memory. With any other vocabulary the library encodes each text as a whole.
    """

    HELD = 400_000
    BATCH_BYTES, BATCH_RUNS = 1 << 20, 8192

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only hold more memory
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        said = json.loads(self.tokenizer.to_str())
        plain = all(said[k] is None for k in ("truncation", "padding", "post_processor"))
        added = all(x["content"].startswith("<|") and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in said["added_tokens"])
        self.parts = plain and added and said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == PRE_TOKENIZER
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.to_level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.pieces, self.runs = Held(self._of_pieces), Held(self._of_runs)

    def _of_pieces(self, new: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[END_ID] if x == "\0" else [t.id for t in tokenize(x if x.isascii() else x.translate(self.to_level))] for x in new]

    def _of_runs(self, new: list[str]) -> list[list[int]]:
        lists = [[END_ID]] if new[:1] == ["\0"] else []
        for k in range(len(lists), len(new), self.BATCH_RUNS):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast(new[k : k + self.BATCH_RUNS], add_special_tokens=False)]
        return lists

    def batches(self, texts: Iterable[bytes]) -> Iterator[list[bytes]]:
        """Texts in lists of about BATCH_BYTES; a longer text is alone."""
        held, size = [], 0
        for x in texts:
            if held and size + len(x) > self.BATCH_BYTES:
                yield held
                held, size = [], 0
            held.append(x)
            size += len(x)
        if held:
            yield held

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, each with the end id."""
        read = [x.decode("utf-8", "replace") for x in texts]
        if not self.parts:
            return [np.array([*e.ids, END_ID], np.uint32) for e in self.tokenizer.encode_batch_fast(read, add_special_tokens=False)]
        whole = "\0".join([*read, ""])
        odd = [False] * len(read)
        if not _all_plain(whole, len(read)):
            odd = [_ODD.search(x) is not None for x in read]
            whole = "\0".join([x for x, o in zip(read, odd, strict=True) if not o] + [""])
        plain = self.pieces.ids(_PIECES.findall(whole.lower()), self.HELD)
        other = self.runs.ids([w for x, o in zip(texts, odd, strict=True) if o for w in (*(y.decode("utf-8", "replace") for y in x.split()), "\0")], self.HELD)
        return [next(other) if o else next(plain) for o in odd]


class Held:
    """The ids of distinct strings; "\\0" closes a text."""

    def __init__(self, learn):
        self.learn = learn
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.known["\0"]
        self.flat, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, strings: list[str], most: int) -> Iterator[np.ndarray]:
        """Ids of each text of strings."""
        if not strings:
            return iter(())
        if len(self.known) > most:
            self.forget()
        at = np.fromiter(map(self.known.__getitem__, strings), np.int64, len(strings))
        if new := self.known.taken():
            flat, sizes, starts = _laid(self.learn(new))
            self.starts, self.sizes = np.concatenate([self.starts, len(self.flat) + starts]), np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat])
        ids, ends = _spread(self.flat, self.starts, self.sizes, at)
        return iter(np.split(ids, ends[np.flatnonzero(at == 0)][:-1]))


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


# Writing and reading


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents' ids to path in ascending doc_id.

    Parts are ranges of doc_id of about equal numbers; a part is one task's, cut into segments.
    """
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows, size = text_size(own)
    parts = max(1, min(-(-size // PART_BYTES), rows, MOST_PARTS))

    def run(batches):
        encoder = encoder_of(tokenizer)
        part = TaskContext.get().partitionId()
        number, ids, names, sizes, held = 0, [], [], [], 0

        def segment():
            nonlocal number, ids, names, sizes, held
            n = np.array(sizes, np.int64)
            payload = encode(np.concatenate(ids), np.array(names, np.int64), np.cumsum(n) - n)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int64()), "first_id": pa.array([names[0]], pa.int64()), "last_id": pa.array([names[-1]], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            number, ids, names, sizes, held = number + 1, [], [], [], 0
            return out

        for batch in batches:
            left = iter(batch.column("doc_id").to_pylist())
            column = batch.column("text").cast(pa.large_binary())
            for texts in encoder.batches(x.as_py() for x in column):
                for own_ids in encoder.encode(texts):
                    if held >= SEGMENT_IDS:
                        yield segment()
                    ids.append(own_ids), names.append(next(left)), sizes.append(len(own_ids))
                    held += len(own_ids)
        if held:
            yield segment()

    dealt = own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, "part int, segment long, first_id long, last_id long, n_ids long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document in the files at path."""
    rows = spark.read.parquet(path)
    # Sums of the parts, a row each, then of the segments inside a part.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    at = rows.select("part", "segment", "n_ids")
    inside = at.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    placed = inside.join(ahead, "part").select(F.col("part").alias("p"), F.col("segment").alias("s"), (F.col("ahead") + F.col("inside")).alias("ahead"))
    whole = rows.join(placed, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s"))).select("ahead", "payload")

    def run(batches):
        for batch in batches:
            for ahead, payload in zip(batch.column("ahead").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                s = Segment(payload)
                ids = s.ids().astype("<u4")
                starts = s.docs["before"].astype(np.int64)
                ends = np.append(starts[1:], s.n_ids)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(s.docs["id"]), "start": pa.array(ahead + starts), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())})

    out = whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(spark, path)
