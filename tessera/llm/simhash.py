"""SimHash near-dedup by the generalised pigeonhole principle.

A fingerprint has a bit for each bit place of the shingles' hashes: 1 if more than half of the hashes have it set. Two
fingerprints link at max_bits or fewer differing bits; documents that links connect form a group.

Search: bits that correlate over the distinct fingerprints go into the same partition. Partition i gets a threshold t_i, and
its part of the bits is probed at every value within t_i flips (t_i = -1: not probed at all). Two fingerprints with at most D
differing bits agree within t_i on some partition whenever the sum of (t_i + 1) exceeds D. The thresholds are unequal:
dynamic programming spends that sum at the least estimated number of probes and candidates, the estimate coming from the counts
of the part values of all distinct fingerprints. Candidates are verified on the whole fingerprint.

Equal fingerprints fold into one node before the search, named by the smallest doc_id. Inside a probed cell verified links
are told as a spanning forest, one link for each node joined, never as all pairs.

With 64-bit fingerprints and 3 bits the search is exact. near_duplicates looks for similarity 0.8 or more of the sets of shingles: wide
fingerprints find candidates, whose sets are then compared exactly. A guarantee on wide fingerprints would need thousands of
probes each; there the dynamic programme spends probes until a pair at the least similarity is met with a stated chance.

Nulls and empty texts have fingerprint zero and link like any other; a null doc_id sorts after all others and gets the smallest doc_id of its group, or null. Rows
that repeat are one node. An empty table gives an empty result. Extra columns are ignored, or kept by near_duplicates.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LAST_ID, fresh, store
from tessera.llm.components import stars
from tessera.llm.packed import mixed, slices, texts

#: Rows of a cell; a probed value of more rows is cut into chunks that meet two by two.
CELL_ROWS = 40_000


def shingle_hashes(data: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of so many words, repeats included; of the whole sequence if it has fewer."""
    w = data.lower().split() if data else []
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], 42) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(w) - k + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """64 * lanes bits, most significant bit first; lane 0 uses the hashes, each further lane a mix of them."""
    out = []
    for lane in range(lanes):
        h = hashes if lane == 0 else mixed(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 4096):  # blocks that stay in the cache
            ones += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (binary) of every document."""

    def run(batches):
        for batch in slices(batches):
            t = pa.Table.from_batches([batch])
            yield from pa.table({"doc_id": t.column("doc_id"), "fp": pa.array([fingerprint(shingle_hashes(x, words), lanes) for x in texts(t, "text")], pa.binary())}).to_batches()

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, fp binary")


# Partitions and thresholds


def bit_statistics(nodes: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the counts of set bits and of pairs of set bits within each lane of 64 (a fixed-size table)."""

    def run(batches):
        both, n = np.zeros((bits // 64, 64, 64), np.int64), 0
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, bits // 8)
            for k in range(0, len(fps), 8192):
                m = np.unpackbits(fps[k : k + 8192], axis=1).astype(np.float32)
                for lane in range(bits // 64):
                    own = m[:, 64 * lane : 64 * lane + 64]
                    both[lane] += (own.T @ own).astype(np.int64)
            n += len(fps)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, both.size), pa.int32()), "n": pa.array(np.concatenate([[n], both.ravel()]), pa.int64())})

    rows = nodes.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # bits * 64 + 1 rows
    both = np.zeros(bits * 64 + 1, np.int64)
    both[rows.column("at").to_numpy() + 1] = rows.column("n").to_numpy()
    return int(both[0]), both[1:].reshape(-1, 64, 64)


def partitions(n: int, both: np.ndarray, width: int) -> list[list[int]]:
    """Bits in groups of width: each group grows around a bit by the bits of its lane that correlate most with those it has."""
    out = []
    for lane in range(len(both)):
        p = np.diag(both[lane]) / max(n, 1)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        tie = np.abs(both[lane] / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
        np.fill_diagonal(tie, 0)
        free = set(range(64))
        while free:
            own = [max(sorted(free), key=lambda b: tie[b, sorted(free)].sum())]
            free.discard(own[0])
            while free and len(own) < width:
                own.append(max(sorted(free), key=lambda b: tie[b, own].sum()))
                free.discard(own[-1])
            out.append([64 * lane + b for b in sorted(own)])
    return out


def thresholds(cost: list[list[float]], budget: int, worth: list[int] | None = None) -> list[int]:
    """t_i of each partition whose worths sum to budget at least, at the least total cost; cost[i][t + 1] is that of threshold t.

    worth[t + 1] is what threshold t is worth: t + 1 unless given (the pigeonhole's guarantee).
    """
    worth = list(range(max(map(len, cost)))) if worth is None else worth
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in cost:
        then: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (total, chosen) in best.items():
            for k, c in enumerate(own):
                now = min(budget, spent + worth[k])
                if now not in then or total + c < then[now][0]:
                    then[now] = (total + c, (*chosen, k - 1))
        best = then
    return list(best[budget][1])


def _part(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value that the fingerprints (rows of bytes) have on bits."""
    value = np.zeros(len(fps), np.int64)
    for b in bits:
        value = (value << 1) | ((fps[:, b >> 3] >> (7 - (b & 7))) & 1)
    return value


def _flips(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in own) for k in range(t + 1) for own in itertools.combinations(range(width), k)]


#: Cost of making, moving and sorting one probe, in comparisons.
PROBE_COST = 40.0


def value_counts(nodes: DataFrame, lanes: int, parts: list[list[int]]) -> DataFrame:
    """i, value, n: how many fingerprints have each value of partition i."""

    def run(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, 8 * lanes)
            for i, bits in enumerate(parts):
                value, number = np.unique(_part(fps, bits), return_counts=True)
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.full(len(value), i), pa.int32()), "value": pa.array(value, pa.int64()), "n": pa.array(number, pa.int64())})

    return nodes.select("fp").mapInArrow(run, "i int, value long, n long").groupBy("i", "value").agg(F.sum("n").alias("n"))


def estimated(counts: DataFrame, n: int, both: np.ndarray, parts: list[list[int]], most: int) -> list[list[float]]:
    """Cost of each threshold -1..most for each partition: probes, and candidates from the counts of all its values."""
    met = counts.groupBy("i").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).collect()  # a row a partition
    pairs = {r["i"]: r["pairs"] for r in met}
    out = []
    for i, bits in enumerate(parts):
        p = np.array([both[b // 64][b % 64, b % 64] for b in bits]) / max(n, 1)
        same = p * p + (1 - p) ** 2
        poly = np.array([1.0])
        for r in (1 - same) / np.maximum(same, 1e-9):  # a bit that differs, against one that agrees
            poly = np.convolve(poly, [1.0, r])
        shells = np.cumsum(poly)
        own = [0.0]
        for t in range(most + 1):
            own.append(PROBE_COST * n * len(_flips(len(bits), t)) + 0.5 * pairs.get(i, 0.0) * shells[min(t, len(shells) - 1)])
        out.append(own)
    return out


# Probe and verify


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit lanes."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of rows at most bits apart that connect the same rows as all such pairs do, each row newly joined once."""
    out = []
    left = np.arange(len(fps))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            own = todo.pop()
            near = _differ(fps[left], fps[own]) <= most
            if near.any():
                found = left[near].tolist()
                out += [(own, x) for x in found]
                todo += found
                left = left[~near]
    return out


def _runs(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and fingerprints of a cell in order of their run, and where each run starts."""
    part, value, sub, node = (cell.column(x).to_numpy() for x in ("part", "value", "sub", "node"))
    fps = np.frombuffer(b"".join(cell.column("fp").to_pylist()), ">u8").reshape(len(node), -1).astype(np.uint64)
    order = np.lexsort((node, sub, value, part))
    part, value, sub = part[order], value[order], sub[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(sub) != 0)]))
    return order, fps[order], starts


def _links_table(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.Table:
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
    both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
    return pa.table({"u": pa.array(both[:, 0], pa.int64()), "v": pa.array(both[:, 1], pa.int64())})


def _cell_links(most: int):
    def links(cell: pa.Table) -> pa.Table:
        """Of the pairs of each run within most bits a spanning forest: each row but the first of those they connect is told once."""
        order, fps, starts = _runs(cell)
        node = cell.column("node").to_numpy()[order]
        sizes = np.diff(np.append(starts, len(node)))
        run = np.repeat(np.arange(len(starts)), sizes)
        short = sizes[run] <= 32
        us, vs, ahead, behind = [], [], [], []
        for d in range(1, 32):  # neighbours at distance d in the same short run
            a = np.flatnonzero((run[d:] == run[:-d]) & short[d:]) if d < len(run) else np.zeros(0, np.int64)
            if not len(a):
                break
            near = (_differ(fps[a], fps[a + d]) <= most) & (node[a] != node[a + d])
            ahead.append(a[near]), behind.append(a[near] + d)
        if ahead:
            a, b = np.concatenate(ahead), np.concatenate(behind)
            least = np.arange(len(node))
            while (least[a] != least[b]).any():
                np.minimum.at(least, b, least[a]), np.minimum.at(least, a, least[b])
            found = np.flatnonzero(least != np.arange(len(node)))
            us.append(node[found]), vs.append(node[least[found]])
        for s, k in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            _, one = np.unique(node[s : s + k], return_index=True)  # a node may probe its own value
            own_fps, own = fps[s : s + k][one], node[s : s + k][one]
            pairs = np.array(spanning(own_fps, most), np.int64).reshape(-1, 2)
            us.append(own[pairs[:, 0]]), vs.append(own[pairs[:, 1]])
        return _links_table(us, vs)

    return links


def _plan(nodes: DataFrame, n: int, most: int) -> tuple[list[list[int]], list[int], DataFrame]:
    """Partitions of 64 bits and their thresholds for an exact search within most bits, and the counts of their values."""
    _, both = bit_statistics(nodes, 64)
    tried = []
    for w in (16, 22, 32):  # wider parts pay once the corpus is large: fewer partitions, more flips each
        parts = partitions(n, both, w)
        reach = max(0, -(-(most + 1) // len(parts)) - 1)
        counts = value_counts(nodes, 1, parts)
        cost = estimated(counts, n, both, parts, min(reach + 1, 3))
        if len(parts) * (len(cost[0]) - 1) >= most + 1:
            chosen = thresholds(cost, most + 1)
            tried.append((sum(c[t + 1] for c, t in zip(cost, chosen, strict=True)), parts, chosen, counts))
    return min(tried, key=lambda x: x[0])[1:]


def _probed(nodes: DataFrame, n: int, parts: list[list[int]], chosen: list[int], counts: DataFrame, kept: int) -> DataFrame:
    """cell, part, value, sub, node, fp (its first kept bytes): each node under each of its probes.

    A value that more than CELL_ROWS fingerprints have is cut into chunks, and each two of them meet under a sub of their own: no
    task gathers a value of any size, and no two rows of it miss each other.
    """

    def probes(batches):
        for batch in batches:
            node = batch.column("node")
            whole = batch.column("fp").to_pylist()
            fps = np.frombuffer(b"".join(whole), np.uint8).reshape(len(node), -1)
            sent = pa.array([x[:kept] for x in whole], pa.binary())
            for i, (own, t) in enumerate(zip(parts, chosen, strict=True)):
                if t >= 0:
                    value = _part(fps, own)
                    for flip in _flips(len(own), t):
                        yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(value), i), pa.int32()), "value": pa.array(value ^ flip, pa.int64()), "node": node, "fp": sent})

    cells = max(1, -(-n * sum(len(_flips(len(p), t)) for p, t in zip(parts, chosen, strict=True) if t >= 0) // CELL_ROWS))
    probed = nodes.select("node", "fp").mapInArrow(probes, "part int, value long, node long, fp binary")
    hot = store(counts.where(F.col("n") > CELL_ROWS).select(F.col("i").alias("part"), "value", F.ceil(F.col("n") / CELL_ROWS).cast("long").alias("chunks")), "hot")
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("node"), F.col("chunks"))
        met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.least(k, own) * F.col("chunks") + F.greatest(k, own))
        subs = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(met)
        probed = probed.join(hot, ["part", "value"], "left").select("part", "value", "node", "fp", F.explode(subs).alias("sub"))
    else:
        probed = probed.withColumn("sub", F.lit(0).cast("long"))
    return probed.withColumn("cell", F.pmod(F.xxhash64("part", "value", "sub"), F.lit(cells)))


def near_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links (u, v) between nodes (node, fp of 64 bits), enough to connect every two fingerprints at most so many bits apart."""
    n = nodes.count()
    return _probed(nodes, n, *_plan(nodes, n, most), 8).groupBy("cell").applyInArrow(_cell_links(most), "u long, v long")


def grouped(prints: DataFrame, most: int) -> DataFrame:
    """prints (doc_id, fp), each row with component_id: the smallest doc_id that links reach."""
    nodes = store(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("node")), "nodes")
    roots = stars(near_links(nodes, most))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    out = prints.join(named, "fp")  # a frequent fingerprint is one row of named: AQE splits its side of prints
    return out.select("doc_id", "fp", F.when(F.col("component_id") != LAST_ID, F.col("component_id")).alias("component_id"))


SHINGLE_WORDS, MAX_BITS = 3, 3


def query(docs: DataFrame) -> DataFrame:
    prints = store(fingerprints(docs, SHINGLE_WORDS), "fingerprints")
    out = grouped(prints, MAX_BITS)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# Near copies of similarity 0.8 or more


#: Lanes of 64 bits over shingles of five words; of these the first CHECK_LANES go with each probe.
NEAR_WORDS, NEAR_LANES, CHECK_LANES, SIMILARITY = 5, 12, 4, 0.8
#: A pair at SIMILARITY is met by some probe with this chance, were its bits independent.
MEETING = 0.975
#: Candidates differ in at most this share of the checked bits beyond their expected share, in standard deviations.
SLACK = 3.3


def _apart(similarity: float) -> float:
    """The chance that a bit of two fingerprints differs, for sets of about equal size at this resemblance."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _wide_plan(nodes: DataFrame, n: int, width: int | None = None) -> tuple[list[list[int]], list[int], DataFrame]:
    """Partitions and thresholds of wide fingerprints, and the counts of their values. Parts widen with the corpus, so that a value's chance
    company stays small; the dynamic programme raises thresholds where that costs least, until the pairs at SIMILARITY are met with chance MEETING."""
    width = min(32, max(16, n.bit_length() - 2)) if width is None else width
    p = _apart(SIMILARITY)
    agree = [sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(t + 1)) for t in range(4)]
    gain = [0.0, *(-math.log1p(-x) for x in agree)]
    worth = [int(x / gain[1] * 8) for x in gain]  # eighths of a plain probe
    need = math.ceil(-math.log(1 - MEETING) / gain[1] * 8)
    _, both = bit_statistics(nodes, 64 * NEAR_LANES)
    parts = [x for x in partitions(n, both, width) if len(x) == width]
    counts = value_counts(nodes, NEAR_LANES, parts)
    cost = estimated(counts, n, both, parts, next((t for t in range(3) if worth[t + 1] * len(parts) >= need), 3))
    return parts, thresholds(cost, min(need, worth[len(cost[0]) - 1] * len(parts)), worth[: len(cost[0])]), counts


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_key, digest (equal sets of shingle hashes have equal ones), fp of every row of docs."""

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(x, NEAR_WORDS)) for x in texts(pa.Table.from_batches([batch]), "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "digest": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), "fp": pa.array([fingerprint(x, NEAR_LANES) for x in sets], pa.binary())})

    return docs.select("doc_id", F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, key long, digest binary, fp binary")


def _packed_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node, own: the packed set of shingle hashes of the document with that key, for the given nodes alone."""

    def run(batches):
        for batch in slices(batches):
            data = texts(pa.Table.from_batches([batch]), "text")
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "own": pa.array([np.unique(shingle_hashes(x, NEAR_WORDS)).tobytes() for x in data], pa.binary())})

    found = docs.select(F.col(key).alias("node"), F.col(text).alias("text")).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    return store(found.mapInArrow(run, "node long, own binary"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with near: whether their sets of shingles have a resemblance of SIMILARITY or more. A pair moves two packed sets."""

    def compared(batches):
        for batch in slices(batches):
            near = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if SIMILARITY * len(a) <= len(b) <= len(a) / SIMILARITY else 0
                near.append(both >= SIMILARITY * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_pydict({"u": batch.column("u"), "v": batch.column("v"), "near": pa.array(near, pa.bool_())})

    left, right = sets.select(F.col("node").alias("u"), F.col("own").alias("a")), sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(compared, "u long, v long, near boolean")


#: Documents of a chunk that meet all others of another chunk in one task, and columns of their table of shingles held at once.
CHUNK, COLUMNS = 2048, 2048


def linked_sets(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of sets of resemblance SIMILARITY or more that connect the same sets as all such pairs do: exact sizes of all
    intersections as products of blocks of the table (set, shingle), of which shingles of one set alone are left out."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    _, column, number = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = number[column] > 1
    row, column = row[shared], (np.cumsum(number > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)  # exact up to 2 ** 24 common shingles
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        here, at = np.unique(row[a:b], return_inverse=True)
        block = np.zeros((len(here), COLUMNS), np.float32)
        block[at, column[a:b] - first] = 1
        both[np.ix_(here, here)] += block @ block.T
    near = both >= SIMILARITY * (size[:, None] + size[None, :] - both)
    out, left = [], np.ones(n, bool)
    for k in range(n):
        if left[k]:
            left[k], todo = False, [k]
            while todo:
                own = todo.pop()
                found = np.flatnonzero(near[own] & left)
                left[found] = False
                out += [(own, x) for x in found.tolist()]
                todo += found.tolist()
    return out


def _within(cell: pa.Table) -> pa.Table:
    """Links of a cell's meetings: a spanning forest of each one's sets of resemblance SIMILARITY or more."""
    meeting, node, root = (cell.column(x).to_numpy() for x in ("meeting", "node", "root"))
    own = cell.column("own").to_pylist()
    order = np.lexsort((node, meeting))
    us, vs = [], []
    for at in np.split(order, np.flatnonzero(np.diff(meeting[order])) + 1):
        if len(at) > 1 and (root[at] != root[at[0]]).any():
            pairs = np.array(linked_sets([np.frombuffer(own[k], np.uint64) for k in at.tolist()]), np.int64).reshape(-1, 2)
            us.append(node[at[pairs[:, 0]]]), vs.append(node[at[pairs[:, 1]]])
    return _links_table(us, vs)


def _apart_links(first: DataFrame, near: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between what the verified links left apart inside groups of candidates.

    Inside such a group the part that most documents belong to is whole: only the others meet all the rest. Both are cut into chunks that
    meet two by two, so that a task holds two chunks whatever the group's size, and tells a forest, never all pairs.
    """
    loose = stars(first).select("node", F.col("root").alias("loose"))
    parts = loose.unionByName(loose.select(F.col("loose").alias("node"), "loose").distinct())
    parts = store(parts.join(stars(near), "node", "left").select("node", "loose", F.coalesce("root", "node").alias("root")), "parts")
    sizes = parts.groupBy("loose", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("loose")
    sizes = sizes.agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")).where(F.col("roots") > 1)
    chunks = lambda n: F.ceil(n / CHUNK).cast("long")
    sizes = sizes.select("loose", F.col("most.root").alias("most"), chunks(F.col("most.n")).alias("wide"), chunks(F.col("all") - F.col("most.n")).alias("few"))
    placed = parts.join(sizes, "loose")
    whole = F.col("root") == F.col("most")
    few = F.sequence(F.lit(0).cast("long"), F.col("few") - 1)
    own = F.pmod(F.xxhash64("node"), F.when(whole, F.col("wide")).otherwise(F.col("few")))
    name = lambda kind, a, b: F.xxhash64("loose", F.lit(kind), a, b)
    mine = F.transform(few, lambda k: name(0, F.least(k, own), F.greatest(k, own)))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1), lambda k: name(1, k, own))
    meetings = F.when(whole, F.transform(few, lambda k: name(1, own, k))).otherwise(F.concat(mine, across))
    met = store(placed.select("node", "root", F.explode(meetings).alias("meeting")).join(sets, "node"), "meetings")
    cells = max(1, -(-met.count() // CHUNK))
    return met.withColumn("cell", F.pmod("meeting", F.lit(cells))).groupBy("cell").applyInArrow(_within, "u long, v long")


def near_groups(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """doc_id, key, root of every row of docs; rows of one root are connected by sets of shingles of resemblance SIMILARITY or more.

    key is a long that only equal rows share. Equal sets are one node. A cell's candidates connect each run by a spanning forest, so that
    a group of copies of any size is a few links a copy. Links are verified on the sets; where one fails, the sets of its group of
    candidates are compared with each other, so that no group hangs on the choice of the forest.
    """
    rows = store(_sets(docs.withColumn("doc_id", F.col(doc_id).cast("long")), key, text), "sets")
    nodes = store(rows.groupBy("digest").agg(F.min("key").alias("node"), F.first("fp").alias("fp")), "nodes")
    n = nodes.count()
    parts, chosen, counts = _wide_plan(nodes, n, width)
    bits, p = 64 * CHECK_LANES, _apart(SIMILARITY)
    limit = int(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))
    found = _probed(nodes, n, parts, chosen, counts, bits // 8).groupBy("cell").applyInArrow(_cell_links(limit), "u long, v long").distinct()
    # A document found in many cells hangs on the least of those it was found with, and these hang on it too: about a link a document.
    least = F.min("v").over(Window.partitionBy("u"))
    hung = found.withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    first = store(hung.distinct(), "pairs")
    asked = store(first.select(F.col("u").alias("node")).union(first.select(F.col("v").alias("node"))).distinct(), "asked")
    sets = _packed_sets(docs, asked, key, text)
    told = store(_verified(first, sets), "told")
    near = told.where("near").select("u", "v")
    if told.where("NOT near").limit(1).count():
        near = store(near.unionByName(_apart_links(first, near, sets)), "near")
    groups = nodes.join(stars(near), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return store(rows.select("doc_id", "key", "digest").join(groups, "digest").select("doc_id", "key", "root"), "groups")


def _row_key(docs: DataFrame):
    """A hash of a whole row, but for maps, which have none."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int | None = None) -> DataFrame:
    """doc_id and component_id (the group's smallest doc_id, or null) of every document, by sets of five-word shingles of similarity 0.8 or more."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = near_groups(own.withColumn("key", _row_key(own)), "key", width=width)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (null last), of several the one of the smallest hash.

    Documents without a word are near copies of each other. Different texts under one doc_id, or under null, are documents of their own.
    """
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, _row_key(docs))
    rows = near_groups(keyed, key, doc_id, text)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "key")).alias("best")).select(F.col("best.key").alias(key))
    same = fresh("same_rows", keyed.columns)
    chosen = store(rows.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias(same)).join(best, key), "chosen")
    kept = keyed.join(chosen, key)
    # Rows that are equal in every column stand for each other.
    return kept.where(F.col(same) == 1).unionByName(kept.where(F.col(same) > 1).dropDuplicates([key])).select(*(F.col(f"`{x}`") for x in docs.columns))
