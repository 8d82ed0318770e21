"""Best-fit packing into bins of several permitted sizes.

Documents are cut into pieces of at most the largest size; each piece goes into the open bin that it leaves fullest (best fit,
longest pieces first). Where none has room a bin opens. Every permitted size that holds the piece is tried on the pieces still to come: the
longest that fits goes in, then the longest that fits beside it, and so on, so that a size is only hoped to hold what the remaining
lengths can give it. The size whose cost for each token so held is least opens. At the end each bin shrinks to the
smallest permitted size that holds its contents.

A bin's cost has a fixed part, a part by length, and a part by its square, as attention has: without the last the largest size would
always be the cheapest.

Pieces are dealt by a hash of the piece into independent packing groups of about GROUP_ROWS, so that no task gathers a source.
A group's pieces stay in order of length, so its waste is that of a shorter list: at most one open bin of each fill.

Nulls: a null or empty text has length 0 and one piece of length 0 in no bin (bin_id null). A null doc_id is packed like any other. Rows that repeat a
doc_id are packed each for itself. An empty table gives an empty result. Nothing is dropped or cut off: the pieces' lengths sum to the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import n_words

#: Permitted sequence lengths, and what a bin of each costs: FIXED_COST + size + size * size / SQUARE.
SIZES = (512, 1024, 2048, 4096)
FIXED_COST, SQUARE = 16, 32768
#: Equal rows that a task makes again at once.
CHUNK = 4096
GROUP_ROWS = 20_000


def cost_of(size: int, fixed: int = FIXED_COST, square: int = SQUARE) -> float:
    return fixed + size + size * size / square


def _hoped(n: int, size: int, present: int, left: np.ndarray) -> int:
    """Tokens that a bin of this size opened for a piece of n would hold, were it filled with the longest pieces that still fit; present: bit r is set if left[r] > 0."""
    held, taken = n, {}
    while room := size - held:
        fits = present & ((1 << (room + 1)) - 1)
        while fits:
            longest = fits.bit_length() - 1
            many = min(room // longest, int(left[longest]) - taken.get(longest, 0))
            if many > 0:
                break
            fits ^= 1 << longest
        if not fits:
            break
        taken[longest] = taken.get(longest, 0) + many
        held += many * longest
    return held


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, fixed: int = FIXED_COST, square: int = SQUARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (1 <= length <= the largest size), and the final size of each bin."""
    sizes = tuple(sorted(sizes))
    largest = sizes[-1]
    costs = [cost_of(s, fixed, square) for s in sizes]
    room_bins: list[list[int]] = [[] for _ in range(largest + 1)]
    free = 0  # bit r is set if a bin with room r is open
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened: list[int] = []
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    left = np.bincount(lengths, minlength=largest + 1)  # pieces to come, by length
    present = sum(1 << int(r) for r in np.flatnonzero(left))
    for k in order.tolist():
        n = int(lengths[k])
        left[n] -= 1
        if not left[n]:
            present ^= 1 << n
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = room_bins[room].pop()
            if not room_bins[room]:
                free ^= 1 << room
            offset = opened[at] - room
        else:
            prices = [(c / _hoped(n, s, present, left), s) for s, c in zip(sizes, costs, strict=True) if s >= n]
            at, room, offset = len(opened), min(prices)[1], 0
            opened.append(room)
        bins[k], offsets[k] = at, offset
        room -= n
        if room:
            room_bins[room].append(at)
            free |= 1 << room
    used = np.zeros(len(opened), np.int64)
    np.add.at(used, bins, lengths)
    return bins, offsets, np.array(sizes)[np.searchsorted(sizes, used)] if len(used) else used


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, words) with copy, which numbers rows of one id and size, null ids too: a hash of the three spreads any id over all groups.

    Equal rows are counted and made again, CHUNK of them in a task at once, so that no task numbers them all.
    """
    counted = sizes.groupBy("doc_id", "words").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))
    dealt = counted.withColumn("chunk", chunk).repartition("doc_id", "words", "chunk")
    return dealt.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1))).select("doc_id", "words", "copy")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset, bin_size: a row for each piece of each document."""
    largest = max(sizes)
    own = numbered(docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("words")))
    rows = docs.count()
    groups = max(1, -(-rows // GROUP_ROWS))
    cut = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("words") / largest) - 1, F.lit(0)).cast("long"))))
    cut = cut.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("words") - F.col("piece") * largest, F.lit(largest)).cast("long").alias("length"), F.pmod(F.xxhash64("doc_id", "piece", "words", "copy"), F.lit(groups)).alias("pack_group"))

    def run(group: pa.Table) -> pa.Table:
        # The same bins whatever order the shuffle brings the rows in.
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = group.column("length").to_numpy()
        some = length > 0
        number = group.column("pack_group")[0].as_py()
        bins, offsets, final = pack(length[some], sizes)
        bin_id, offset, size = (np.zeros(len(length), np.int64) for _ in range(3))
        bin_id[some], offset[some], size[some] = (number << 32) + bins, offsets, final[bins] if len(bins) else 0
        return group.select(["doc_id", "piece", "start", "length"]).append_column("bin_id", pa.array(bin_id, mask=~some)).append_column("bin_offset", pa.array(offset, mask=~some)).append_column("bin_size", pa.array(size, mask=~some))

    kind = own.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("pack_group").applyInArrow(run, f"doc_id {kind}, piece long, start long, length long, bin_id long, bin_offset long, bin_size long")


def query(docs: DataFrame) -> DataFrame:
    return packed(docs)
