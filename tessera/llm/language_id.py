"""Language identification by error-correcting output codes.

Each learned language gets a codeword; a linear classifier on hashed character n-grams predicts each bit. The margins of all bits
are decoded by loss: the language whose codeword loses least wins, and a document is ambiguous if the runner-up loses hardly more.

Training: rows with a text and a non-null language, at most PER_LANGUAGE of each language, the first by a hash of their doc_id,
whole texts; the driver gets their n-gram rates, a bounded table. Languages of fewer than MIN_ROWS rows are not learned. Prediction
reads the text alone, whole, and covers every document.

Nulls: a null text or one without a letter is `und` with score 0; so is every text if nothing could be learned. A null doc_id
can be predicted, and is not trained on. Rows that repeat get equal predictions. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import uniform
from tessera.llm.packed import texts

PER_LANGUAGE, MIN_ROWS = 1500, 5
SLOTS = 1 << 15
BLOCK_ROWS = 256
EPOCHS, RATE, DECAY = 60, 2.0, 1e-5
AMBIGUOUS = 0.1
UND = "und"
#: ASCII letters in lower case; digits, signs and controls become a space; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(data: bytes | None) -> bool:
    if not data:
        return False
    return bool(_ASCII_LETTER.search(data)) or any(c.isalpha() for c in data.decode("utf-8", "replace"))


def slots(data: bytes) -> np.ndarray:
    """Slots of the byte n-grams of 2 to 4 of a text, words set in single spaces."""
    b = np.frombuffer(b" " + b" ".join(data.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 4:
        b = np.concatenate([b, np.full(4 - len(b), 32, np.uint32)])
    out = []
    for n in (2, 3, 4):
        code = np.zeros(len(b) - n + 1, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | b[k : len(b) - n + 1 + k]
        out.append(((code + np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761)) >> np.uint32(32 - 15))
    return np.concatenate(out)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of +1 and -1: every split of few languages, random splits of many."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        columns = [[1 if j == 0 or not m >> (j - 1) & 1 else -1 for j in range(k)] for m in range(1, 1 << (k - 1))]
    else:
        rng, columns = np.random.default_rng(seed), []
        while len(columns) < max(15, int(np.ceil(10 * np.log2(k)))):
            c = rng.choice([-1, 1], k)
            if abs(c.sum()) < k:
                columns.append((c * c[0]).tolist())
    return np.array(columns, float).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    bias: np.ndarray

    def margins(self, data: bytes) -> np.ndarray:
        at = slots(data)
        if len(at) > SLOTS:
            number = np.bincount(at, minlength=SLOTS)
            return number @ self.weights / len(at) + self.bias
        return self.weights[at].sum(axis=0) / len(at) + self.bias

    def decode(self, margin: np.ndarray) -> tuple[str, float, bool]:
        """Language, score, and whether the second comes close."""
        loss = np.logaddexp(0, -self.code * margin).sum(axis=1)  # logistic loss of each codeword, weighed by the margins
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmax(p))
        rest = np.delete(p, best)
        return self.languages[best], float(p[best]), bool(len(rest) and p[best] - rest.max() < AMBIGUOUS)


def learned(rows: DataFrame) -> Model | None:
    """A model from rows (doc_id, text, lang)."""
    usable = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # Candidates by id first, so that texts of the chosen rows alone move. A share of each language's ids, by their hash and of about
    # twice the number wanted, is ranked: no task gets all ids of a frequent language.
    ids = usable.select("doc_id", "lang").distinct().withColumn("u", uniform(F.col("doc_id"), F.lit(23)))
    numbers = ids.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    few = ids.join(numbers, F.col("lang") == F.col("of")).where(F.col("u") * F.col("n") < 2 * PER_LANGUAGE)
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))).where(F.col("r") <= PER_LANGUAGE)
    chosen = ranked.select(F.col("doc_id").alias("chosen_id")).distinct()

    def rates(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out = []
            for x in texts(t, "text"):
                at, number = np.unique(slots(x), return_counts=True) if has_letter(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                out.append((at.astype("<u2").tobytes(), (number / max(number.sum(), 1)).astype("<f4").tobytes()))
            yield from pa.table({"doc_id": t.column("doc_id"), "lang": t.column("lang"), "at": pa.array([x[0] for x in out], pa.binary()), "rate": pa.array([x[1] for x in out], pa.binary())}).to_batches()

    taken = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"), "left_semi")
    # A doc_id that many rows share is trained on once.
    taken = taken.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("doc_id", "one.text", "one.lang")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = taken.mapInArrow(rates, f"doc_id {kind}, lang string, at binary, rate binary").orderBy("lang", F.xxhash64("doc_id"), "doc_id").toArrow().to_pydict()
    seen = Counter(x for x, at in zip(found["lang"], found["at"], strict=True) if at)
    languages = sorted(x for x, n in seen.items() if n >= MIN_ROWS)
    if not languages:
        return None
    use = [k for k, (x, at) in enumerate(zip(found["lang"], found["at"], strict=True)) if at and x in languages]
    y = np.array([languages.index(found["lang"][k]) for k in use])
    sizes = np.array([len(found["at"][k]) // 2 for k in use])
    at = np.frombuffer(b"".join([found["at"][k] for k in use]), "<u2")
    rate = np.frombuffer(b"".join([found["rate"][k] for k in use]), "<f4").copy()
    del found
    return fitted(languages, y, sizes, at, rate)


def fitted(languages: list[str], y: np.ndarray, sizes: np.ndarray, at: np.ndarray, rate: np.ndarray) -> Model:
    """A model from the n-gram rates of rows one after the other; sizes: the n-grams of each row. The rates stay sparse: BLOCK_ROWS rows are dense at a time."""
    code, ends = codewords(len(languages)), np.concatenate([[0], np.cumsum(sizes)])

    def blocks():
        for a in range(0, len(y), BLOCK_ROWS):
            b = min(a + BLOCK_ROWS, len(y))
            own = slice(ends[a], ends[b])
            x = np.zeros((b - a, SLOTS), np.float32)
            x[np.repeat(np.arange(b - a), sizes[a:b]), at[own]] = rate[own]
            yield slice(a, b), x

    squares = np.zeros(SLOTS)
    for _, x in blocks():
        squares += np.einsum("ij,ij->j", x, x)
    scale = (1.0 / np.maximum(np.sqrt(squares / len(y)), 1e-4)).astype(np.float32)  # rates of frequent and rare n-grams on one scale
    for a in range(0, len(rate), 1 << 20):
        rate[a : a + (1 << 20)] *= scale[at[a : a + (1 << 20)]]
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]
    weights, bias = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    target = code[y]
    norm = float(squares @ (scale.astype(float) ** 2)) / len(y)
    for _ in range(EPOCHS):  # full-batch logistic regression of all bits at once, each language weighing the same
        slope, shift = np.zeros_like(weights), np.zeros_like(bias)
        for own, x in blocks():
            miss = target[own] / (1 + np.exp(np.clip(target[own] * (x @ weights + bias), -30, 30))) * share[own, None] / share.sum()
            slope += x.T @ miss.astype(np.float32)
            shift += miss.sum(axis=0)
        weights += np.float32(RATE * 8 / norm) * slope - np.float32(DECAY) * weights
        bias += 0.1 * shift
    return Model(languages, code, np.ascontiguousarray(weights * scale[:, None], np.float32), bias)


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score, ambiguous."""

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out = [model.decode(model.margins(x)) if model and has_letter(x) else (UND, 0.0, False) for x in texts(t, text)]
            yield from pa.table({"doc_id": t.column("doc_id"), "lang_pred": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64()), "ambiguous": pa.array([x[2] for x in out], pa.bool_())}).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    model = learned(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
