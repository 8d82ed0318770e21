"""Texts around a question and its answer (inventory A3, A5, F10, F21, Q1, R15, T7). Each function takes one row's values; the queries run them over whole tables."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

from tessera.registry import frame

_CITE = re.compile(r"\[(\d+)\]")
_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
WINDOW, LEAD = 120, 30
SHRINK, FLOOR, ROUNDS = 0.8, 40, 60


def numbers(text: str) -> set[str]:
    """Numbers without thousands separators."""
    return {x.replace(",", "").rstrip(".") for x in _NUMBER.findall(_CITE.sub(" ", text))}


def numbers_supported(line: str, evidence: list[str]) -> bool:
    return numbers(line) <= set().union(*map(numbers, evidence))


def recite(answer: str, evidence: list[str]) -> str:
    """A sentence whose numbers are not all in the evidence it cites, but all in exactly one other, cites that one instead."""
    facts = [numbers(x) for x in evidence]
    out = []
    for sentence in re.split(r"((?<=[.!?。\]])\s+)", answer):
        cited = {int(x) for x in _CITE.findall(sentence)}
        own = numbers(sentence)
        if cited and own and not any(own <= facts[k - 1] for k in cited if 1 <= k <= len(facts)):
            other = [k for k in range(1, len(facts) + 1) if k not in cited and own <= facts[k - 1]]
            if len(other) == 1:
                first = _CITE.search(sentence)
                sentence = sentence[: first.start()] + f"[{other[0]}]" + _CITE.sub("", sentence[first.end() :])
        out.append(sentence)
    return "".join(out)


def clean_answer(text: str, echoes: tuple[str, ...] = ()) -> str:
    """Without lines that echo the instructions, bold marks, and repeats of one citation at a line's end."""
    kept = [x for x in text.split("\n") if not any(e and e in x for e in echoes)]
    lines = []
    for x in kept:
        x = re.sub(r"\*\*(.+?)\*\*", r"\1", x)
        x = re.sub(r"^\s*#{1,6}\s+", "", x)
        lines.append(re.sub(r"(\[\d+\])(?:\s*\1)+", r"\1", x).rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def line_ok(line: str, evidence: list[str], echoes: tuple[str, ...] = ()) -> bool:
    """A line of a brief: at least 20 characters, no echo of the instructions, its numbers in the evidence."""
    return len(line.strip()) >= 20 and not any(e and e in line for e in echoes) and numbers_supported(line, evidence)


def fit_prompt(evidence: list[str], fixed: int, budget: int, length=len) -> list[str]:
    """Evidence cut until fixed and all lengths fit the budget: the longest loses a fifth each round, until that would leave fewer than FLOOR characters of it."""
    out = list(evidence)
    for _ in range(ROUNDS):
        if fixed + sum(map(length, out)) <= budget or not out:
            break
        k = max(range(len(out)), key=lambda k: len(out[k]))
        left = int(len(out[k]) * SHRINK)
        if left < FLOOR:
            break
        out[k] = out[k][:left]
    return out


def loop_start(tokens: list, least: int = 4, times: int = 3) -> int:
    """Where a tail that repeats a block of at least `least` tokens `times` times begins its second turn; len(tokens) if there is none.

    A border of the reversed tail at distance p means period p: the Z-array of the reversed tokens gives for each p how far it reaches.
    """
    back = tokens[::-1]
    n, left, right = len(back), 0, 0
    z = [0] * n
    for k in range(1, n):
        if k < right:
            z[k] = min(right - k, z[k - left])
        while k + z[k] < n and back[z[k]] == back[k + z[k]]:
            z[k] += 1
        if k + z[k] > right:
            left, right = k, k + z[k]
    for p in range(least, n // times + 1):
        if z[p] >= p * (times - 1):
            return n - z[p]
    return n


def guard(tokens: list, cap: int, least: int = 4, times: int = 3) -> tuple[list, str]:
    """The tokens up to a loop or the cap, and why they end: loop, cap or end."""
    for k in range(least * times, min(len(tokens), cap) + 1):
        at = loop_start(tokens[:k], least, times)
        if at < k:
            return tokens[:at], "loop"
    return (tokens[:cap], "cap") if len(tokens) > cap else (tokens, "end")


def snippet(text: str, words: list[str], window: int = WINDOW, lead: int = LEAD) -> tuple[str, list[tuple[int, int]]]:
    """The window of the text, white space folded, with the most places of words, the first of the best, and where these stand in it.

    A word that the text does not hold is looked for by its first two letters. The window opens `lead` characters before a place, and never so late that it would end after the text.
    """
    text = " ".join(text.split())
    low = text.lower() if len(text.lower()) == len(text) else text
    found = []
    for w in (x.lower() for x in words if x):
        for form in (w, w[:2]) if len(w) > 2 else (w,):
            if spans := [(m.start(), m.end()) for m in re.finditer(re.escape(form), low)]:
                found += spans
                break
    found.sort()
    best, start, last = 0, 0, max(0, len(text) - window)
    begins, ends = [a for a, b in found if b - a <= window], sorted(b for a, b in found if b - a <= window)
    for a in begins if last else ():
        at = min(max(0, a - lead), last)
        n = bisect_right(ends, at + window) - bisect_left(begins, at)  # those that begin before `at` end before `at + window`
        if n > best:
            best, start = n, at
    end = min(len(text), start + window)
    ahead = "…" if start else ""
    marks = [(a - start + len(ahead), b - start + len(ahead)) for a, b in sorted(set(found)) if start <= a and b <= end]
    return ahead + text[start:end] + ("…" if end < len(text) else ""), marks


def expand(query: str, rules: dict[str, list[str]], rejected: set[tuple[str, str]] = frozenset()) -> str:
    """The query with the terms of the everyday words in it: longest word first, at a word's start, on no span twice; terms that it holds are skipped."""
    words = sorted(((w, t) for t, own in rules.items() for w in own if (w, t) not in rejected), key=lambda x: (-len(x[0]), x))
    bare, used, added = re.sub(r"\s+", "", query).lower(), [], []
    for w, term in words:
        for m in re.finditer(r"(?<!\w)" + re.escape(w), query, re.IGNORECASE):
            if any(a < m.end() and m.start() < b for a, b, own in used if own != w):
                continue
            used.append((m.start(), m.end(), w))
            if re.sub(r"\s+", "", term).lower() not in bare and term not in added:
                added.append(term)
            break
    return " ".join([query, *added])


# Queries over whole tables


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@frame()
def snippets(spark, d):
    """A snippet of every document for the words of its own first line."""
    make = F.udf(lambda t: snippet(t or "", re.findall(r"\w+", (t or "").split("\n")[0])), "struct<text:string, marks:array<struct<a:int, b:int>>>")
    return _docs(spark, d).select("doc_id", make("text").alias("s")).select("doc_id", "s.text", F.to_json("s.marks").alias("marks"))


@frame()
def fit_prompts(spark, d):
    """The turns of each conversation as evidence, cut to 400 characters in all."""
    make = F.udf(lambda t: fit_prompt([x for x in t if x], 0, 400), "array<string>")
    turns = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return turns.select("conv_id", make("t").alias("kept")).select("conv_id", F.size("kept").alias("n"), F.aggregate("kept", F.lit(0), lambda s, x: s + F.length(x)).alias("chars"))


@frame()
def loop_guard(spark, d):
    """Where the words of each document begin to loop."""
    make = F.udf(lambda t: loop_start((t or "").split()), "int")
    return _docs(spark, d).select("doc_id", make("text").alias("kept"))


@frame()
def recited(spark, d):
    """Each assistant turn with its citations mended against the turns before it."""
    make = F.udf(lambda t, e: recite(t or "", [x or "" for x in e]), "string")
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    before = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("all"))
    own = turns.where("role = 'assistant'").join(before, "conv_id")
    evidence = F.transform(F.filter("all", lambda x: x["turn"] < F.col("turn")), lambda x: x["text"])
    return own.select("conv_id", "turn", make(F.concat("text", F.lit(" [1]")), evidence).alias("answer"))
