"""Phrase collocations: counts of 1 to 3 words at the slots of perfect hashes over Apriori-safe candidates.

Texts are lower-cased (A-Z), split at marks and line ends into pieces, and these at blanks into words. A phrase is counted where its words
stand next to each other in a piece. Slices of text are stored once as numbers of their words. Level by level, mappers read them and name each candidate of a slice once: an n-gram whose
two shorter parts are frequent. What is frequent they see in a bitmap of at most 2**BITS bits, which may let others through but never
keeps one out. Keys (a 64-bit key and 32 bits to check it, of the words and the language) go, packed, to the shard of their range.
A shard builds the minimal perfect hash over its candidates, with the checks stored by slot, bincounts each slice's keys into an array
over the slots, once its stored checks agree, and sums the arrays. Candidates that share their 64 bits are counted in a list apart. What is
frequent goes into the stored index: a perfect hash, checks and counts by slot. Cuts of a phrase are read there by slot.

Arrays over all candidates from every mapper would grow with the square of the corpus, so a mapper's array is of one slice and one shard;
mappers send its filled slots alone, as keys, and the sum is by slice, then by shard.

Nulls: a null text is empty, a null lang is `und`, as is a lang of that name; ids are never read. Rows that repeat a text count again. An
empty table gives an empty result. Long texts are read in pieces of about CHUNK bytes, cut at piece ends. Ties fall to a, then to the phrase's bytes.
Other columns are not read.
"""

from __future__ import annotations

import collections
import itertools

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import store, text_size
from tessera.llm.line_dedup import PerfectHash
from tessera.llm.packed import mixed, planes, shards, slices, texts, unplanes

LEAST, MOST_WORDS, TOP, COVERED = 10, 3, 2000, 50
SLICE_BYTES, CHUNK, SHARD_BYTES = 16 << 20, 2 << 20, 16 << 20
#: Bits of a level's bitmap: 64 for each frequent n-gram, as a power of two, at most 2**BITS (32 MB).
BITS, BLOCK = 28, 15
#: Parts of a language's phrases that are ranked apart first.
PARTS = 64
#: Marks and line ends part pieces, blanks part words.
PARTED = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
STEP = np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64(0xFFFFFFFF)


def _halves(words: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers of each word."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in words), "<u8").reshape(-1, 2)


def _longer(keys: np.ndarray, halves: np.ndarray) -> np.ndarray:
    """Keys of phrases that go on with the word of halves."""
    return mixed(keys * STEP + halves)


def _first(lang: str, halves: np.ndarray) -> np.ndarray:
    return _longer(_halves([lang.encode()]), halves)


def _shard(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each 64-bit key: equal ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold keys: False is sure."""
    at = keys >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Words:
    """The words of texts in one language as numbers; -1 parts pieces."""

    def __init__(self, lang: str):
        self.lang = lang
        self.numbers = collections.defaultdict(itertools.count().__next__, {b"": -2, b"\n": -1})
        self.read: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        data = text.lower().translate(PARTED)  # bytes: A-Z alone
        self.size += len(data)
        at = 0
        while at < len(data):
            end = data.find(b"\n", at + CHUNK)
            end = len(data) if end < 0 else end
            tokens = (data[at:end] + b"\n").replace(b"\n", b" \n ").split(b" ")
            numbers = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
            self.read.append(numbers[numbers > -2].astype("<i4"))
            at = end

    def row(self) -> dict:
        squeeze = zstandard.ZstdCompressor(1).compress
        return {"lang": self.lang, "words": squeeze(b"\n".join(list(self.numbers)[2:])), "numbers": squeeze(np.concatenate([*self.read, np.array([-1], "<i4")]).tobytes())}


def _encoded(batches):
    """The texts of a task, SLICE_BYTES at a time: a row for each language, its words and their numbers in reading order."""

    def rows(found: dict[str, Words]):
        for own in found.values():
            yield pa.RecordBatch.from_pylist([own.row()], pa.schema([("lang", pa.string()), ("words", pa.binary()), ("numbers", pa.binary())]))

    open_: dict[str, Words] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
            if text:
                own = open_.setdefault(lang, Words(lang))
                own.add(text)
        if sum(x.size for x in open_.values()) >= SLICE_BYTES:
            yield from rows(open_)
            open_ = {}
    yield from rows(open_)


def _slices(batches):
    """lang, words and numbers of each encoded slice."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in ("lang", "words", "numbers")}
            loose = zstandard.ZstdDecompressor().decompress
            words = loose(row["words"])
            yield row["lang"], words.split(b"\n") if words else [], np.frombuffer(loose(row["numbers"]), "<i4").astype(np.int64)


def _grams(lang: str, words: list[bytes], at: np.ndarray, level: int, bits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of each level up to level: their words' numbers (a row each), keys and counts."""
    halves = _halves(words)
    own, count = np.unique(at[at >= 0], return_counts=True)
    keys = _first(lang, halves)
    found = [(own[:, None], keys[own], count)]
    number, grams = at, np.arange(len(halves))[:, None]  # number: of the n-gram that begins at each place
    for n in range(2, level + 1):
        frequent = _held(bits[n - 2], keys[:, 0])
        safe = np.append(frequent, False)[number]
        places = np.flatnonzero(safe[:-1] & safe[1:])
        code, index, count = np.unique(number[places] << 32 | at[places + n - 1], return_inverse=True, return_counts=True)
        begin, last = code >> 32, code & 0xFFFFFFFF
        keys, grams = _longer(keys[begin], halves[last]), np.concatenate([grams[begin], last[:, None]], axis=1)
        found.append((grams, keys, count))
        number = np.full(len(at), -1)
        number[places] = index
    return found


def _packed(keys: np.ndarray, counts: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """Rows of a shard each: its keys, ascending and Rice-coded, their checks, and counts as bytes, with those from 255 on in full behind."""
    order = np.argsort(keys[:, 0], kind="stable")
    keys, counts = keys[order], counts[order]
    names, starts = np.unique(_shard(keys[:, 0], n_shards), return_index=True)
    rows: dict[str, list] = {"shard": names.tolist(), "keys": [], "checks": [], "counts": []}
    for a, b in itertools.pairwise([*starts.tolist(), len(keys)]):
        own = counts[a:b]
        rows["keys"].append(planes(keys[a:b, 0]))
        rows["checks"].append((keys[a:b, 1] & LOW).astype("<u4").tobytes())
        rows["counts"].append(np.minimum(own, 255).astype("u1").tobytes() + own[own >= 255].astype("<i8").tobytes())
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in rows.items()})


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, checks = unplanes(row["keys"]), np.frombuffer(row["checks"], "<u4")
    counts = np.frombuffer(row["counts"], "u1", len(keys)).astype(np.int64)
    counts[counts == 255] = np.frombuffer(row["counts"], "<i8", offset=len(keys))
    return keys, checks, counts


def _named(level: int, n_shards: int, shared: list):
    def named(batches):
        bits = [x.value for x in shared]
        for lang, words, at in _slices(batches):
            _, keys, counts = _grams(lang, words, at, level, bits)[-1]
            if len(keys):
                yield _packed(keys, counts, n_shards)

    return named


class Slots:
    """Distinct keys (64 bits and a check of 32) by slot of a perfect hash; those that share the 64 bits in a dictionary."""

    def __init__(self, table: PerfectHash, checks: np.ndarray, apart: dict[tuple[int, int], int]):
        self.table, self.checks, self.apart = table, checks, apart

    @classmethod
    def of(cls, keys: np.ndarray, checks: np.ndarray) -> Slots:
        """From keys that may repeat."""
        order = np.lexsort((checks, keys))
        keys, checks = keys[order], checks[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1]))[: len(keys)]
        keys, checks = keys[new], checks[new]
        same = np.append(keys[1:] == keys[:-1], False)[: len(keys)]
        apart = same | np.append(False, same[:-1])[: len(keys)]
        table = PerfectHash.of(keys[~apart])
        stored = np.zeros(int((~apart).sum()), np.uint32)
        stored[table.index(keys[~apart])] = checks[~apart]
        return cls(table, stored, {k: len(stored) + i for i, k in enumerate(zip(keys[apart].tolist(), checks[apart].tolist(), strict=True))})

    def __len__(self) -> int:
        return len(self.checks) + len(self.apart)

    def index(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where its stored check differs."""
        at = self.table.index(keys)
        right = at >= 0
        right[right] = self.checks[at[right]] == checks[right]
        at[~right] = -1
        for k in np.flatnonzero(~right).tolist() if self.apart else []:
            at[k] = self.apart.get((int(keys[k]), int(checks[k])), -1)
        return at


def _counted(level: int, least: int):
    def counted(told: pa.Table) -> pa.Table:
        """A shard's row of the index: keys, checks and counts of what is frequent, by slot."""
        rows = [_unpacked(x) for x in told.to_pylist()]
        keys, checks = np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows])
        slots = Slots.of(keys, checks)
        total = np.zeros(len(slots), np.int64)
        for own, own_checks, counts in rows:
            total += np.bincount(slots.index(own, own_checks), weights=counts, minlength=len(slots)).astype(np.int64)
        at = slots.index(keys, checks)
        frequent = np.flatnonzero(total >= least)
        first = np.zeros(len(slots), np.int64)
        first[at] = np.arange(len(at))
        keys, checks, total = keys[first[frequent]], checks[first[frequent]], total[frequent]
        kept = Slots.of(keys, checks)
        by_slot = np.empty((len(kept), 3), np.uint64)
        by_slot[kept.index(keys, checks)] = np.stack([keys, checks.astype(np.uint64), total.astype(np.uint64)], axis=1)
        return pa.table(
            {
                "level": pa.array([level], pa.int32()),
                "shard": told.column("shard")[:1],
                "n": pa.array([len(kept)], pa.int64()),
                "hash": pa.array([kept.table.packed()], pa.binary()),
                "slots": pa.array([by_slot.tobytes()], pa.binary()),
            }
        )

    return counted


INDEX = "level int, shard int, n long, hash binary, slots binary"


def _bit_blocks(b: int):
    def blocks(batches):
        for batch in batches:
            for slots in batch.column("slots").to_pylist():
                at = np.unique(np.frombuffer(slots, "<u8").reshape(-1, 3)[:, 0] >> np.uint64(64 - b)).astype(np.int64)
                names, starts = np.unique(at >> BLOCK, return_index=True)
                made = []
                for own in np.split(at & (1 << BLOCK) - 1, starts[1:]) if len(at) else []:
                    block = np.zeros(1 << BLOCK, np.uint8)
                    block[own] = 1
                    made.append(np.packbits(block, bitorder="little").tobytes())
                yield pa.RecordBatch.from_pydict({"block": pa.array(names, pa.int64()), "bits": pa.array(made, pa.binary())})

    return blocks


def bitmap(index: DataFrame, most: int = BITS):
    """A level's bitmap, shared with all executors: 2**most bits at most."""
    n = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    b = min(most, max(BLOCK, (64 * n).bit_length()))
    bits = np.zeros((1 << b) // 8, np.uint8)
    width = (1 << BLOCK) // 8
    for row in index.mapInArrow(_bit_blocks(b), "block long, bits binary").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        bits[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return index.sparkSession.sparkContext.broadcast(bits)


def _phrases(level: int, shared: list):
    def phrases(batches):
        """Phrases of two words and more that may be frequent, once a slice."""
        bits = [x.value for x in shared]
        for lang, words, at in _slices(batches):
            for n, (grams, keys, _) in enumerate(_grams(lang, words, at, level, bits)[1:], 1):
                kept = grams[_held(bits[n], keys[:, 0])].tolist()
                if kept:
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(kept)), "phrase": pa.array([b" ".join(words[k] for k in x) for x in kept], pa.binary()).cast(pa.string())})

    return phrases


def _asked(n_shards: int):
    def asked(batches):
        """For each phrase the keys of itself (part 0) and of the two parts of each cut: part 2k - 1 and 2k."""
        for batch in batches:
            split = [x.split(b" ") for x in texts(batch, "phrase")]
            langs = batch.column("lang").to_pylist()
            for level in sorted({len(x) for x in split}):
                for lang in sorted({x for x, y in zip(langs, split, strict=True) if len(y) == level}):
                    rows = [k for k, (x, y) in enumerate(zip(langs, split, strict=True)) if x == lang and len(y) == level]
                    halves = _halves([w for k in rows for w in split[k]]).reshape(len(rows), level, 2)
                    own = batch.take(pa.array(rows))
                    for part in range(2 * level - 1):
                        cut = (part + 1) // 2
                        a, b = (0, level) if not part else (0, cut) if part % 2 else (cut, level)
                        keys = _first(lang, halves[:, a])
                        for k in range(a + 1, b):
                            keys = _longer(keys, halves[:, k])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "lang": own.column("lang"),
                                "phrase": own.column("phrase"),
                                "part": pa.array([part] * len(rows), pa.int32()),
                                "level": pa.array([b - a] * len(rows), pa.int32()),
                                "shard": pa.array(_shard(keys[:, 0], n_shards), pa.int32()),
                                "key": pa.array(keys[:, 0].view(np.int64)),
                                "check": pa.array((keys[:, 1] & LOW).astype(np.int64)),
                            }
                        )

    return asked


def _read(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Counts of the asked keys, by slot."""
    f = np.zeros(len(asked), np.int64)
    if len(index) and len(asked):
        by_slot = np.frombuffer(index.column("slots")[0].as_py(), "<u8").reshape(-1, 3)
        table = PerfectHash.unpacked(index.column("hash")[0].as_py())
        alone = table.size
        apart = {(int(k), int(c)): alone + i for i, (k, c, _) in enumerate(by_slot[alone:].tolist())}
        slots = Slots(table, by_slot[:alone, 1].astype(np.uint32), apart)
        at = slots.index(asked.column("key").to_numpy().view(np.uint64), asked.column("check").to_numpy().astype(np.uint32))
        f[at >= 0] = by_slot[at[at >= 0], 2].astype(np.int64)
    return asked.select(["lang", "phrase", "part"]).append_column("f", pa.array(f))


def phrase_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, n_words, f (array: the phrase's count, then those of both parts of each cut) of all phrases of 2 to most_words words that stand at least least times."""
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    n_shards = shards(text_size(docs, text)[1], SHARD_BYTES)
    own = store(own.mapInArrow(_encoded, "lang string, words binary, numbers binary"), "slices")
    indexes, bits = [], []
    for level in range(1, most_words + 1):
        named = own.mapInArrow(_named(level, n_shards, bits), "shard int, keys binary, checks binary, counts binary")
        indexes.append(store(named.groupBy("shard").applyInArrow(_counted(level, least), INDEX), f"phrases{level}"))
        bits = [*bits, bitmap(indexes[-1])]
    phrases = own.mapInArrow(_phrases(most_words, bits), "lang string, phrase string").distinct()
    asked = phrases.mapInArrow(_asked(n_shards), "lang string, phrase string, part int, level int, shard int, key long, check long")
    index = indexes[0]
    for other in indexes[1:]:
        index = index.unionByName(other)
    read = asked.groupBy("level", "shard").cogroup(index.groupBy("level", "shard")).applyInArrow(_read, "lang string, phrase string, part int, f long")
    parts = [F.max(F.when(F.col("part") == k, F.col("f"))) for k in range(2 * most_words - 1)]
    counts = read.groupBy("lang", "phrase").agg(F.array_compact(F.array(*parts)).alias("f")).where(F.col("f")[0] >= least)
    return store(counts.select("lang", "phrase", (F.size(F.split("phrase", " "))).alias("n_words"), "f"), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, covered: int = COVERED, text: str = "text", lang: str = "lang") -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(10**6 * a * a / (l * r)); a phrase has that of its lowest cut, the smallest of equal ones. A phrase goes whose
    words lie in a longer candidate that has at least covered hundredths of its count.
    """
    counts = phrase_counts(docs, least, most_words, text, lang)
    big = lambda x: x.cast("decimal(16,0)")
    a = F.col("f")[0]
    cuts = F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda k: F.struct(k.alias("k"), F.get("f", 2 * k - 1).alias("l"), F.get("f", 2 * k).alias("r")))
    spelled = counts.withColumn("cut", F.explode(cuts)).select("lang", "phrase", "n_words", big(a).alias("a"), "cut.k", big(F.col("cut.l")).alias("l"), big(F.col("cut.r")).alias("r"))
    scored = spelled.withColumn("score", F.expr("(1000000BD * (a * a)) div (l * r)"))
    best = scored.groupBy("lang", "phrase", "n_words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("lang", "phrase", "n_words", "best.*")
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))))
    longer = counts.where("n_words > 2").select("lang", F.explode(inner).alias("phrase"), a.alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    best_first = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best_first)  # a language may hold most phrases: only the best of each part meet
    few = kept.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).where(F.col("rank") <= top)
    n_words = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"))
    sums = docs.groupBy(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")).agg(F.sum(n_words).cast("long").alias("n"))
    long = [F.col(x).cast("long").alias(x) for x in ("a", "l", "r", "n", "score")]
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *long)


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("lang", "text"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(ws) AS phrase, 1 AS size FROM w
      UNION ALL SELECT lang, unnest(list_transform(generate_series(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+1], ' '))), 2 FROM w WHERE len(ws) >= 2
      UNION ALL SELECT lang, unnest(list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+2], ' '))), 3 FROM w WHERE len(ws) >= 3),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT lang, phrase, size, f AS a, unnest(generate_series(1, size - 1)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
sides AS (SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
          FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k+1:], ' ')),
best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM best WHERE size = 3),
covers AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covers c ON c.lang = b.lang AND c.phrase = b.phrase WHERE c.longer IS NULL OR 100 * c.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
