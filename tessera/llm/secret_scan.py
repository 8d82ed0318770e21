"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived: every text that the rule matches holds, for each of the query's clauses, all
trigrams of one of its alternatives. Postings (trigram, block, hashes of texts; texts in blocks by their hash) are built for the trigrams that
rules ask for and stored; a rule's query is answered block by block by intersecting and uniting postings. The texts found are verified by the
expression itself. A rule without mandatory trigrams scans all texts. Trigrams are those of the text with A-Z in lower case, so they never miss a match.

Everything here is DataFrame functions. Postings hold the hash of a text, so copies are one entry; two texts with one hash are verified alike, by
their own text. Very long texts are cut into overlapping pieces to list trigrams, and are verified whole.

Nulls: a null text is empty; a null or repeated doc_id does not matter, as spans depend on the text alone. Repeated rows each get their spans. An
empty table gives an empty result. Other columns pass through; a column named as the result gets a longer name. Ties of start fall to the order of rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, store

#: Texts a block of postings, code points a piece, alternatives and class members that a query spells out.
BLOCK_ROWS, PIECE, MOST_STRINGS, MOST_MEMBERS = 1 << 14, 1 << 16, 128, 8


@dataclass(frozen=True)
class Rule:
    """Matches of pattern (in the syntax that Java and Python share), leftmost and apart, whose group has at least least code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D/@]+@"),
)
#: A clause is a list of alternatives, each a set of trigrams.
Clause = list[frozenset[str]]


def folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _low(code: int) -> str:
    return chr(code + 32 if 65 <= code <= 90 else code)


def _shortest(clause: Clause) -> Clause:
    """Alternatives without those that another one covers."""
    own = sorted(set(clause), key=lambda x: (len(x), sorted(x)))
    return [x for k, x in enumerate(own) if not any(y <= x for y in own[:k])]


def _clause(strings: set[str]) -> list[Clause]:
    """What a text holds that holds one of strings: no clause if one is too short to tell."""
    alternatives = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
    return [_shortest(alternatives)] if alternatives and all(alternatives) else []


def _members(items) -> set[str] | None:
    """The characters of a class, folded; None if it is negated, by category, or large."""
    found: set[str] = set()
    for op, value in items:
        if op is kinds.LITERAL:
            found.add(_low(value))
        elif op is kinds.RANGE and value[1] - value[0] < 4 * MOST_MEMBERS:
            found |= {_low(k) for k in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_MEMBERS else None


def _either(branches: list[list[Clause]]) -> list[Clause]:
    """The clause of one branch or another: each must have one, and they are spelled out only while few."""
    merged: Clause = []
    for clauses in branches:
        if not clauses:
            return []
        merged += min(clauses, key=len)
    return [_shortest(merged)] if len(merged) <= MOST_STRINGS else []


def _parts(tree) -> tuple[set[str] | None, list[Clause]]:
    """Of an expression: all strings that it matches, if few, else None; and the clauses that hold besides."""
    strings, clauses, exact = {""}, [], True
    for op, value in tree:
        own: set[str] | None = None
        inner: list[Clause] = []
        if op is kinds.LITERAL:
            own = {_low(value)}
        elif op is kinds.IN:
            own = _members(value)
        elif op in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            own = {""}
        elif op is kinds.SUBPATTERN:
            own, inner = _parts(value[-1])
        elif op is kinds.BRANCH:
            each = [_parts(x) for x in value[1]]
            if all(x is not None for x, _ in each):
                own = set().union(*(x for x, _ in each))
            else:
                inner = _either([c + (_clause(x) if x is not None else []) for x, c in each])
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, body = value
            held, inner = _parts(body)
            if least == 0:
                inner = []
            if held is not None and most <= 4 and len(held) ** int(most) <= MOST_STRINGS:
                own = set()
                for n in range(least, int(most) + 1):
                    grown = {""}
                    for _ in range(n):
                        grown = {a + b for a in grown for b in held}
                    own |= grown
            elif held is not None and least:
                inner = inner + _clause(held)
        if own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
            clauses += inner
            continue
        clauses += _clause(strings) + inner
        exact, strings = False, own if own is not None else {""}
    return (strings, clauses) if exact else (None, clauses + _clause(strings))


def trigram_query(pattern: str) -> list[Clause]:
    """The Boolean query of an expression: clauses that all hold, of alternatives of which one holds. Empty: no trigram is mandatory."""
    strings, clauses = _parts(parser.parse(pattern))
    return clauses + (_clause(strings) if strings is not None else [])


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text."""
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_index(docs: DataFrame, only: list[str] | None = None, text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored postings of the texts: trigram, block, ids (hashes of texts). only: the trigrams to post, None for all."""
    n_blocks = max(1, -(-docs.count() // block_rows))
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("text").alias("h"), "text")
    cut = F.when(F.length("text") > PIECE, F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE)), lambda k: F.substring(F.col("text"), (k * PIECE + 1).cast("int"), F.lit(PIECE + 2)))).otherwise(F.array("text"))
    each = trigrams(F.col("piece"))
    if only is not None:
        each = F.array_intersect(each, F.lit(sorted(only)) if only else F.array().cast("array<string>"))
    rows = own.select("h", F.explode(cut).alias("piece")).select("h", F.explode(each).alias("trigram"))
    return store(rows.groupBy("trigram", F.pmod("h", F.lit(n_blocks)).cast("int").alias("block")).agg(F.collect_set("h").alias("ids")), "trigrams")


def candidates(index: DataFrame, queries: list[list[Clause]]) -> DataFrame:
    """h, mask: for each text that some query finds, bit k for query k. Postings are intersected within a block."""
    named = sorted({t for q in queries for clause in q for x in clause for t in x})
    none = F.array().cast("array<bigint>")

    def of(trigram: str) -> Column:
        return F.coalesce(F.col("held")[trigram], none)

    def all_of(items: list[Column]) -> Column:
        out = items[0]
        for x in items[1:]:
            out = F.array_intersect(out, x)
        return out

    found = [all_of([F.array_distinct(F.flatten(F.array(*(all_of([of(t) for t in sorted(x)]) for x in clause)))) for clause in q]) for q in queries]
    held = index.where(F.col("trigram").isin(named)).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("held"))
    each = held.select(F.explode(F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), x.alias("ids")) for k, x in enumerate(found)))).alias("e"))
    return each.select("e.bit", F.explode("e.ids").alias("h")).groupBy("h").agg(F.bit_or("bit").alias("mask"))


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Structs (start, kind, end) of a rule's matches, code points, end exclusive. Starts are sums of the sizes before, by blocks of the square root of their number."""
    every, caught = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    step = F.zip_with(F.split(text, rule.pattern, -1), every, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y)

    def placed(x: Column) -> Column:
        steps, sizes, caught, width = x["steps"], x["sizes"], x["caught"], x["width"]
        blocks = F.sequence(F.lit(0), F.floor(F.size(steps) / width).cast("int"))
        bases = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda s, b: F.array_append(s, F.element_at(s, -1) + total(F.slice(steps, b * width + 1, width))))

        def one(y: Column) -> Column:
            def at(size: Column, k: Column) -> Column:
                block = F.floor(k / width).cast("int")
                end = F.get(y["bases"], block) + total(F.slice(steps, block * width + 1, k - block * width + 1))
                return F.struct((end - size).alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.get(caught, k).alias("caught"))

            return F.filter(F.transform(sizes, at), lambda z: z["caught"] >= rule.least)

        return F.flatten(F.transform(F.array(F.struct(bases.alias("bases"))), one))

    length = lambda x: F.transform(x, lambda m: F.length(m).cast("long"))
    width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(every)))).cast("int")
    whole = F.flatten(F.transform(F.array(F.struct(step.alias("steps"), length(every).alias("sizes"), length(caught).alias("caught"), width.alias("width"))), placed))
    return F.when(text.rlike(rule.pattern), F.transform(whole, lambda z: F.struct(z["start"], z["kind"], z["end"])))


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a column of all spans (start, kind: number of the rule, end), by start, then kind; and the column's name."""
    asked = {k: q for k, q in enumerate(trigram_query(r.pattern) for r in rules) if q}
    index = trigram_index(docs, sorted({t for q in asked.values() for clause in q for x in clause for t in x}), text)
    found = candidates(index, list(asked.values()))
    h, mask, name = (fresh(x, docs.columns) for x in ("text_hash", "rule_mask", "spans"))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn(h, F.xxhash64(whole)).join(found.select(F.col("h").alias(h), F.col("mask").alias(mask)).hint("shuffle_hash"), h, "left")
    bit = {k: n for n, k in enumerate(asked)}
    each = []
    for k, rule in enumerate(rules):
        own = spans(whole, rule, k)
        each.append(F.coalesce(F.when(F.col(mask).bitwiseAND(F.lit(1 << bit[k]).cast("long")) != 0, own) if k in bit else own, F.array().cast(SPANS)))
    return rows.select(*docs.columns, F.array_sort(F.flatten(F.array(*each))).alias(name)), name


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.lit([r.kind for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def query(docs: DataFrame) -> DataFrame:
    done, name = scan(docs.select("doc_id", "text"))
    kinds_of = F.transform(name, lambda x: x["kind"])
    n = [(F.size(kinds_of) - F.size(F.array_remove(kinds_of, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base]
    base = F.filter(name, lambda x: x["kind"] < sum(r.base for r in RULES))
    return done.select("doc_id", *n, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col(name)).alias("spans"))
