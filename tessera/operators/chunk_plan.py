"""Chunks of structured texts (inventory C1, C2, C6, C9, C10, C12): sections by headings, greedy packing, pages of chunks.

A text is a row's own; its chunks depend on nothing else, so plan() runs in Arrow batches without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.registry import frame

SIZE, OVERLAP, LEAST, HARD_MAX = 128, 16, 16, 510
WHOLE_TABLE, HEADER_MAX = 384, 64
HEADINGS_NEEDED = 3
PAGE_KEY, PAGE_KEY_LEAST, PAGE_OFFSETS = 24, 8, (0, 40, 80, 120)

# Heading forms, tried in this order.
GRAMMARS = {
    "article": re.compile(r"^\s*(?:제\s*\d+\s*[조장절관](?:의\s*\d+)?|Article\s+\d+)", re.IGNORECASE),
    "markdown": re.compile(r"^\s{0,3}#{1,6}\s+\S"),
    "numbered": re.compile(r"^\s*\d{1,3}(?:\.\d{1,3})*\.?\s+\S"),
}


def tokens_of(text: str) -> int:
    """Number of words; callers may give a tokenizer's count instead."""
    return len(text.split())


def grammar_of(lines: list[str]) -> str:
    """The first grammar of which at least three lines are headings."""
    return next((name for name, form in GRAMMARS.items() if sum(bool(form.match(x)) for x in lines) >= HEADINGS_NEEDED), "none")


@dataclass
class Section:
    label: str = ""
    lines: list[str] = field(default_factory=list)


def sections_of(text: str) -> list[Section]:
    """Sections by the text's grammar; what stands before the first heading is a section without label. Without a grammar the text is one section."""
    lines = text.split("\n")
    form = GRAMMARS.get(grammar_of(lines))
    out = [Section()]
    for line in lines:
        if form and form.match(line):
            out.append(Section(re.sub(r"^[\s#]+", "", line).strip()))
        out[-1].lines.append(line)
    return [s for s in out if any(x.strip() for x in s.lines)]


def is_row(line: str) -> bool:
    x = line.strip()
    return len(x) > 1 and x.startswith("|") and x.endswith("|")


def units_of(lines: list[str], length: Callable[[str], int] = tokens_of) -> list[tuple[str, str]]:
    """(header, text) of a section's units: a table of at most WHOLE_TABLE tokens is one, a longer one is its rows under its first row's header."""
    out: list[tuple[str, str]] = []
    k = 0
    while k < len(lines):
        if not is_row(lines[k]):
            if lines[k].strip():
                out.append(("", lines[k]))
            k += 1
            continue
        end = k
        while end < len(lines) and is_row(lines[end]):
            end += 1
        rows = lines[k:end]
        if length("\n".join(rows)) <= WHOLE_TABLE:
            out.append(("", "\n".join(rows)))
        else:
            header = rows[0] if length(rows[0]) <= HEADER_MAX else ""
            out += [(header, x) for x in (rows[1:] if header else rows)]
        k = end
    return out


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Windows of words that overlap; one of under `least` words is left out, a lone one too."""
    w = text.split()
    out = []
    for at in range(0, max(len(w), 1), size - overlap):
        own = w[at : at + size]
        if len(own) >= least:
            out.append(" ".join(own))
        if at + size >= len(w):
            break
    return out


def _split_unit(header: str, text: str, size: int, length: Callable[[str], int]) -> list[str]:
    """A unit too long for a chunk: its sentences packed, a sentence too long in turn by words."""
    room = max(1, size - (length(header) if header else 0))
    out, held = [], ""
    for sentence in re.split(r"(?<=[.!?。])\s+", text):
        if held and length(f"{held} {sentence}") > room:
            out.append(held)
            held = ""
        if length(sentence) > room:
            w = sentence.split()
            cut = []
            for word in w:
                if cut and length(" ".join([*cut, word])) > room:
                    out.append(" ".join(cut))
                    cut = []
                cut.append(word)
            held = " ".join(cut)
        else:
            held = f"{held} {sentence}".strip()
    if held:
        out.append(held)
    return [f"{header}\n{x}" if header else x for x in out]


def pack(sections: Iterable[Section], size: int = SIZE, hard: int = HARD_MAX, length: Callable[[str], int] = tokens_of) -> list[tuple[str, str]]:
    """(label, text) of chunks: whole sections together while they fit, one too long by its units under their table header.

    A heading that would end a chunk alone goes to the next one. No chunk is longer than `hard`.
    """
    chunks: list[tuple[str, list[str]]] = []
    held: list[str] = []
    label = ""

    def close():
        nonlocal held, label
        if held:
            chunks.append((label, held))
        held, label = [], ""

    def put(own: str, text: str):
        nonlocal label
        if held and length("\n".join([*held, text])) > size:
            last = held[-1] if len(held) > 1 and any(f.match(held[-1]) for f in GRAMMARS.values()) else None
            if last is not None:
                held.pop()
            close()
            if last is not None:
                held.append(last)
        label = label or own
        held.append(text)

    for s in sections:
        whole = "\n".join(s.lines).strip("\n")
        if length(whole) <= size:
            put(s.label, whole)
            continue
        close()
        before = None
        for header, text in units_of(s.lines, length):
            pieces = [text] if length(text) + (length(header) if header else 0) <= size else _split_unit(header, text, size, length)
            for piece in pieces:
                full = "\n".join([*held, piece])
                if header and not piece.startswith(header) and (before != header or not held or length(full) > size):
                    piece = f"{header}\n{piece}"
                put(s.label, piece)
                before = header
        close()
    close()
    out = []
    for own, lines in chunks:
        text = "\n".join(lines)
        out += [(own, text)] if length(text) <= hard else [(own, x) for x in _split_unit("", text, hard, length)]
    return out


def bare(text: str) -> str:
    return "".join(text.split())


def pages_of(chunks: list[str], pages: list[str]) -> list[tuple[int, int]]:
    """(first page, last page) of each chunk, from 1; 0 where it is not found. A chunk's ends are looked for in the pages' text without white space,
    from where the chunk before began; an end that is not there is tried again some characters further in."""
    joined = "".join(map(bare, pages))
    starts, at = [], 0
    for p in pages:
        starts.append(at)
        at += len(bare(p))

    def page_at(place: int) -> int:
        return sum(1 for s in starts if s <= place) if place >= 0 else 0

    out, cursor = [], 0
    for c in chunks:
        own = bare(c)
        first = last = -1
        for skip in PAGE_OFFSETS:
            key = own[skip : skip + PAGE_KEY]
            if len(key) >= min(PAGE_KEY_LEAST, len(own)) and key and first < 0:
                first = joined.find(key, cursor)
        for skip in PAGE_OFFSETS:
            end = len(own) - skip
            key = own[max(0, end - PAGE_KEY) : max(0, end)]
            if len(key) >= min(PAGE_KEY_LEAST, len(own)) and key and last < 0:
                last = joined.find(key, first if first >= 0 else cursor)
                last += len(key) - 1 if last >= 0 else 0
        cursor = first if first >= 0 else cursor
        first, last = (first if first >= 0 else last), (last if last >= 0 else first)
        out.append((page_at(first), max(page_at(last), page_at(first))))
    return out


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, chunk_idx, grammar, label, text, n_tokens of the chunks of each text. A null or empty text has none."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grammar = grammar_of((t or "").split("\n"))
                rows += [(i, k, grammar, label, x, tokens_of(x)) for k, (label, x) in enumerate(pack(sections_of(t or ""), size))]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "chunk_idx", "grammar", "label", "text", "n_tokens"])

    from pyspark.sql import functions as F

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_idx int, grammar string, label string, text string, n_tokens int")


@frame()
def chunk_structured(spark, d):
    """Chunks of every whole document by its headings."""
    return plan(spark.read.parquet(f"{d}/documents.parquet"))


@frame(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM w WHERE len(w) > 0"""
)
def chunk_blocks(spark, d):
    """The chunks of every document hold its words, each once and in order (texts without tables): joined, they are the text's own."""
    from pyspark.sql import functions as F

    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    chunks = plan(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "chunk_idx", words.alias("w"))
    joined = chunks.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "w"))), lambda x: x["w"])).alias("w"))
    return joined.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))
