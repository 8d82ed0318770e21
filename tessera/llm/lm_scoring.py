"""Stupid-backoff scores of documents under the n-gram counts of the corpus they lie in.

S(w | c) = count(c w) / count(c) if the table holds c w, else BACKOFF * S(w | c without its first word); S(w) = count(w) / words.
The counts that score a document are those of all other documents: its own occurrences are taken off, since a table that holds
the document itself would never back off. A word that no other document has counts once. Words are runs of non-space characters,
A-Z in lower case; n-grams stay inside a document. Every n-gram of the corpus is in the tables, whatever its count.

The count tables are partitioned by a hash of the n-gram. The n-grams of a document are exploded inside its batch, where
equal ones fold to one entry with their number, and joined to the tables by that hash; sums are by document. Keys are 64-bit
hashes of the words: among k different n-grams about k * k / 2**65 pairs share a key (one pair in 6 * 10**9 n-grams).

Nulls: a null or empty text has 0 words, log_score 0 and null means; a null doc_id is scored like any other. Rows that repeat are
documents of their own and score alike. An empty table gives an empty result. Nothing is sampled or cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, store, text_size
from tessera.llm.packed import dealt, mixed, planes, shards, texts, unplanes

ORDER, BACKOFF = 3, 0.4
SHARD_BYTES = 8 << 20


def _grams(data: list[bytes | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text; for each n the 64-bit keys of the n-grams that end at each word (0: none)."""
    hashes: dict[bytes, int] = {}
    parts, sizes = [], []
    for x in data:
        words = x.lower().split() if x else []
        for w in set(words):
            if w not in hashes:
                hashes[w] = xxhash.xxh3_64_intdigest(w)
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        sizes.append(len(words))
    lengths = np.array(sizes, np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = [mixed(flat)]
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, np.uint64), keys[-1][:-1]])[: len(flat)]
        longer = mixed(before * np.uint64(0x9E3779B97F4A7C15) + flat + np.uint64(n))
        keys.append(np.where(place >= n - 1, longer, np.uint64(0)))
    return lengths, keys


class _Folded:
    """The keys of one level: distinct ones with their number, the place of each word's key among them, and its number in its own document."""

    def __init__(self, keys: np.ndarray, document: np.ndarray):
        some = np.flatnonzero(keys)
        self.order = some[np.argsort(keys[some], kind="stable")]  # documents stay in order inside a key
        k, d = keys[self.order], document[self.order]
        new = np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]])
        other = new | np.concatenate([np.ones(min(1, len(k)), bool), d[1:] != d[:-1]])
        self.distinct, self.at, self.words = k[new], np.cumsum(new) - 1, len(keys)
        self.number = np.diff(np.append(np.flatnonzero(new), len(k)))
        self.own = np.diff(np.append(np.flatnonzero(other), len(k)))[np.cumsum(other) - 1]

    def others(self, totals: np.ndarray) -> np.ndarray:
        """What other documents hold of each word's n-gram, given the corpus counts of the distinct keys."""
        out = np.zeros(self.words, np.int64)
        out[self.order] = totals[self.at] - self.own
        return out


def _counts(x: np.ndarray, usual: int) -> bytes:
    """Counts that mostly equal usual: a bit for each that does not, then these in planes of 4 bytes, or of 8 where one does not fit."""
    other = x != usual
    rest = x[other]
    rest = rest.astype("<u4" if not len(rest) or rest.max() < 1 << 32 else "<u8")
    return np.packbits(other).tobytes() + np.ascontiguousarray(rest.view(np.uint8).reshape(len(rest), rest.itemsize).T).tobytes()


def _from_counts(data: bytes, n: int, usual: int) -> np.ndarray:
    out, cut = np.full(n, usual, np.int64), -(-n // 8)
    other = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, cut), count=n))
    if len(other):
        width = (len(data) - cut) // len(other)
        out[other] = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=cut).reshape(width, -1).T).view(f"<u{width}").ravel()
    return out


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards are ranges of the upper 32 bits."""
    return (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)


def _shrunk(text: str):
    def shrunk(batches):
        """Texts as zstd frames, which halves what the exchange moves."""
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            at = batch.schema.get_field_index(text)
            data = [None if x is None else pack(x) for x in texts(pa.Table.from_batches([batch]), text)]
            yield batch.set_column(at, text, pa.array(data, pa.binary()))

    return shrunk


def _read(batch: pa.Table, text: str) -> list[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if x is None else unpack(x) for x in batch.column(text).to_pylist()]


def _requests(batch_at: str, text: str, n_shards: int, order: int):
    def requests(batch: pa.Table) -> pa.Table:
        """The batch's keys, a row a level and shard."""
        out: dict[str, list] = {"shard": [], "level": [], "keys": [], "number": []}
        lengths, keys = _grams(_read(batch, text), order)
        document = np.repeat(np.arange(len(lengths)), lengths)
        for level, own in enumerate(keys, 1):
            folded = _Folded(own, document)
            held, starts = np.unique(_shard(folded.distinct, n_shards), return_index=True)
            for shard, a, b in zip(held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(folded.distinct)], strict=False):
                out["shard"].append(shard), out["level"].append(level)
                out["keys"].append(planes(folded.distinct[a:b])), out["number"].append(_counts(folded.number[a:b], 1))
        at = pa.array([batch.column(batch_at)[0].as_py()] * len(out["shard"]), pa.int32())
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "level": pa.array(out["level"], pa.int32()), "batch": at, "keys": pa.array(out["keys"], pa.binary()), "number": pa.array(out["number"], pa.binary())})

    return requests


def _answers(asked: pa.Table) -> pa.Table:
    """One shard of the count table, and what other batches hold of each batch's keys, in the order of these."""
    lists = [unplanes(x) for x in asked.column("keys").to_pylist()]
    number = np.concatenate([_from_counts(x, len(k), 1) for x, k in zip(asked.column("number").to_pylist(), lists, strict=True)])
    flat = np.concatenate(lists)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]])
    totals = np.add.reduceat(number[order], np.flatnonzero(new))
    back = np.empty(len(flat), np.int64)
    back[order] = totals[np.cumsum(new) - 1]
    found = [_counts(x, 0) for x in np.split(back - number, np.cumsum([len(x) for x in lists])[:-1])]
    return pa.table({"batch": asked.column("batch"), "shard": asked.column("shard"), "level": asked.column("level"), "counts": pa.array(found, pa.binary())})


def _scored(doc_id: str, text: str, n_shards: int, order: int, backoff: float):
    def scored(batch: pa.Table, answers: pa.Table) -> pa.Table:
        """Sums of a batch's documents; log S(w) leaves out the number of words, which unigrams counts."""
        lengths, keys = _grams(_read(batch, text), order)
        document = np.repeat(np.arange(len(lengths)), lengths)
        packed = {(a, b): x for a, b, x in zip(answers.column("level").to_pylist(), answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True)}
        of = []
        for level, own in enumerate(keys, 1):
            folded = _Folded(own, document)
            held, starts = np.unique(_shard(folded.distinct, n_shards), return_index=True)
            sizes = np.diff(np.append(starts, len(folded.distinct)))
            elsewhere = [_from_counts(packed[level, s], n, 0) for s, n in zip(held.tolist(), sizes.tolist(), strict=True)]
            of.append(folded.others(folded.number + np.concatenate([np.zeros(0, np.int64), *elsewhere])))
        score = np.log10(np.maximum(of[0], 1))
        single = np.ones(len(score), np.int64)  # 1 where S ends in S(w)
        backed = np.zeros(len(score), np.int64)
        for n in range(2, order + 1):
            context = np.concatenate([np.zeros(1, np.int64), of[n - 2][:-1]])[: len(score)]
            hit, exists = of[n - 1] > 0, keys[n - 1] != 0
            score = np.where(hit, np.log10(np.maximum(of[n - 1], 1) / np.maximum(context, 1)), score + exists * np.log10(backoff))
            single[hit] = 0
            if n == order:
                backed = (exists & ~hit).astype(np.int64)
        sums = lambda x: np.bincount(document, x, len(lengths))
        return pa.table(
            {
                doc_id: batch.column(doc_id),
                "n_words": pa.array(lengths, pa.int64()),
                "log_score": pa.array(sums(score), pa.float64()),
                "n_backoff": pa.array(sums(backed).astype(np.int64), pa.int64()),
                "unigrams": pa.array(sums(single).astype(np.int64), pa.int64()),
            }
        )

    return scored


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score (sum of log10 S), n_backoff (words whose longest n-gram no other document holds), mean_log_score, perplexity."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    _, size = text_size(own)
    at = fresh("batch_no", own.columns)
    rows = dealt(own, size, at, "doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_shrunk("text"), f"doc_id {kind}, text binary, `{at}` int")
    groups, n_shards = rows.groupBy(at), shards(size, SHARD_BYTES)
    asked = groups.applyInArrow(_requests(at, "text", n_shards, order), "shard int, level int, batch int, keys binary, number binary")
    answers = asked.groupBy("shard").applyInArrow(_answers, "batch int, shard int, level int, counts binary")
    schema = f"doc_id {kind}, n_words long, log_score double, n_backoff long, unigrams long"
    sums = store(groups.cogroup(answers.groupBy("batch")).applyInArrow(_scored("doc_id", "text", n_shards, order, backoff), schema), "scores")
    words = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    log_score = F.col("log_score") - F.col("unigrams") * F.log10(F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double"))
    out = sums.withColumn("log_score", log_score).drop("unigrams")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.withColumn("mean_log_score", mean).withColumn("perplexity", F.pow(F.lit(10.0), -mean))


def query(docs: DataFrame) -> DataFrame:
    return backoff_scores(docs)
