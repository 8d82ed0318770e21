"""The stored index against one built anew, and chunk plans on literal texts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk_plan as C
from tessera.operators import index


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, text string")


def scores(spark, path, queries):
    return {(r["query_id"], r["chunk_id"]): r["score"] for r in index.search(spark, path, queries).collect()}


def test_deltas_score_as_a_rebuild(spark, tmp_path):
    rows = [(k, f"alpha beta{k % 3} gamma{k % 7} " + "delta " * (k % 5)) for k in range(200)]
    queries = spark.createDataFrame([(1, ["alpha", "beta1"]), (2, ["gamma3", "delta"]), (3, ["nowhere"])], "query_id long, terms array<string>")
    path = str(tmp_path / "index")
    assert index.load(spark, path) is None and index.is_stale(spark, path, "a")
    assert index.refresh(frame(spark, rows), path, "a") == "full" and index.refresh(frame(spark, rows), path, "a") == "same"
    assert not index.is_stale(spark, path, "a") and index.is_stale(spark, path, "b")
    changed = [*rows[3:], (500, "alpha beta1 beta1 new"), (501, "delta gamma3")]
    changed[10] = (changed[10][0], "beta1 alone")
    assert index.refresh(frame(spark, changed), path, "b") == "update"
    again = [x for x in changed if x[0] != 501]
    assert index.refresh(frame(spark, again), path, "c") == "update"
    whole = str(tmp_path / "whole")
    index.build(frame(spark, again), whole, "c")
    assert scores(spark, path, queries) == scores(spark, whole, queries) != {}
    assert index.prune(spark, path)
    assert index.refresh(frame(spark, again[:100]), path, "d") == "full"
    assert len(index.load(spark, path)["postings"]) == 1


def test_a_broken_index_is_none(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(frame(spark, [(1, "a b")]), path, "a")
    os.remove(f"{path}/.manifest-1.json.crc") if os.path.exists(f"{path}/.manifest-1.json.crc") else None
    with open(f"{path}/manifest-1.json", "w") as out:
        out.write('{"version": 2, "tok')
    assert index.load(spark, path) is None
    assert index.refresh(frame(spark, [(1, "a b")]), path, "a") == "full"


def test_a_write_cut_short_leaves_the_state_before(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "index"), [(k, f"alpha beta{k % 3}") for k in range(100)]
    queries = spark.createDataFrame([(1, ["alpha", "beta1", "new"])], "query_id long, terms array<string>")
    index.build(frame(spark, rows), path, "a")
    want = scores(spark, path, queries)

    def lost(*_):
        raise OSError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(index.manifest, "save", lost)
        with pytest.raises(OSError):
            index.refresh(frame(spark, [*rows, (500, "new alpha")]), path, "b")
    assert scores(spark, path, queries) == want and index.is_stale(spark, path, "b") and index.prune(spark, path)
    with open(f"{path}/manifest-2.json", "w") as out:  # as a writer leaves it that cannot rename whole files
        out.write("{")
    assert scores(spark, path, queries) == want
    assert index.refresh(frame(spark, [*rows, (500, "new alpha")]), path, "b") == "update"
    assert (1, 500) in scores(spark, path, queries)
    with pytest.raises(RuntimeError):
        index.manifest.save(spark, path, {"a": 1}) and monkeypatch.setattr(index.manifest, "names", lambda *_: []) or index.manifest.save(spark, path, {"a": 1})


def test_a_text_is_split_once(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "index"), []
    whole = index._split
    monkeypatch.setattr(index, "_split", lambda texts: (seen.append(sorted(r["text"] for r in texts.collect())), whole(texts))[1])
    rows = [(k, f"alpha beta{k % 3}") for k in range(100)]
    index.build(frame(spark, rows), path, "a")
    index.refresh(frame(spark, [*rows[2:], (200, "alpha beta1"), (201, "gamma")]), path, "b")
    index.refresh(frame(spark, [(k, "alpha beta2") for k in range(50)]), path, "c")  # a new base, of known texts
    assert len(seen) == 2 and set(seen[0]) == {"alpha beta0", "alpha beta1", "alpha beta2"} and seen[1] == ["gamma"]


@pytest.mark.parametrize("forward", [0, 10**9])
def test_skipping_loses_no_result(spark, tmp_path, monkeypatch, forward):
    """The k best of random corpora with small blocks, ties and deltas, in a scope and without, by either way to the full scores."""
    monkeypatch.setattr(index, "FORWARD", forward)
    for name, x in (("BLOCK", 4), ("SLICE", 16), ("SEED", 6), ("MERGE_SHARE", 0.5)):
        monkeypatch.setattr(index, name, x)
    rng = random.Random(4)
    text = lambda: " ".join(f"t{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 30)))
    rows = [(k, text()) for k in range(400)] + [(1000 + k, "t1 t2 t3") for k in range(30)] + [(2000, None), (2001, "")]
    queries = [(q, [f"t{int(rng.paretovariate(0.5))}" for _ in range(rng.randrange(1, 12))]) for q in range(25)] + [(99, ["t1", "t2", "t3"]), (100, ["none"])]
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    path = str(tmp_path / "index")
    index.build(frame(spark, rows), path, "a")
    later = [(k, text() if k % 9 == 0 else t) for k, t in rows if k % 11] + [(5000 + k, text()) for k in range(20)]
    assert index.refresh(frame(spark, later), path, "b") == "update"
    whole = str(tmp_path / "whole")
    index.build(frame(spark, later), whole, "b")
    inside = spark.createDataFrame([(k,) for k, _ in later if k % 3], "chunk_id long")
    every = scores(spark, whole, asked)
    assert scores(spark, path, asked) == every != {}
    for k, scope in ((5, None), (1, None), (5, inside)):
        want = {}
        for q, _ in queries:
            own = sorted((-s, c) for (i, c), s in every.items() if i == q and (scope is None or c % 3))
            want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(own[:k])}
        for p in (path, whole):
            assert {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in index.search_top(spark, p, asked, k, scope).collect()} == want


def test_grammars():
    assert C.grammar_of(["제1조 목적", "x", "제 2 조 정의", "Article 3"]) == "article"
    assert C.grammar_of(["# a", "## b", "### c"]) == "markdown"
    assert C.grammar_of(["1. a", "1.1 b", "2 c"]) == "numbered" and C.grammar_of(["1. a", "text", "2. c"]) == "none"
    got = C.sections_of("front\n# A\none\n## B\ntwo\n# C\n")
    assert [(s.label, s.lines[0]) for s in got] == [("", "front"), ("A", "# A"), ("B", "## B"), ("C", "# C")]


def test_units_and_packing():
    rows = ["| h | k |", *(f"| {k} | v{k} |" for k in range(200))]
    assert C.units_of(["x", *rows[:5]]) == [("", "x"), ("", "\n".join(rows[:5]))]
    long = C.units_of(rows)
    assert len(long) == 200 and long[0] == ("| h | k |", "| 0 | v0 |")
    chunks = C.pack([C.Section("T", rows)], size=40)
    assert all(t.startswith("| h | k |") and C.tokens_of(t) <= 40 for _, t in chunks)
    assert [x for _, t in chunks for x in t.split("\n") if x != rows[0]] == rows[1:]
    a, b = C.Section("A", ["# A", "w " * 50]), C.Section("B", ["# B", "w " * 50])
    assert len(C.pack([a, b], size=128)) == 1 and len(C.pack([a, b], size=60)) == 2
    assert C.pack([a, b], size=60)[1][0] == "B"
    assert all(C.tokens_of(t) <= 510 for _, t in C.pack([C.Section("", ["w " * 2000])], size=5000))
    assert C.windows("w " * 10) == [] and len(C.windows("w " * 250)) == 3 and C.windows("") == []
    # a heading that would end a chunk goes to the next
    got = C.pack([C.Section("A", ["w " * 30]), C.Section("B", ["# B"]), C.Section("C", ["v " * 30])], size=40)
    assert [t.split("\n")[0].strip().split(" ")[0] for _, t in got] == ["w", "#"]


def test_pages():
    pages = ["first page has these words and some more of them", "second page goes on with other words here", "third page ends"]
    chunks = ["first page has these words and some", "more of them second page goes on with", "with other words here third page ends", "not in any page of all"]
    assert C.pages_of(chunks, pages) == [(1, 1), (1, 2), (2, 3), (0, 0)]


def test_plan_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "# A\nx\n# B\ny\n# C\nz"), (None, "plain words")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["chunk_idx"], r["grammar"], r["n_tokens"]) for r in C.plan(docs).collect()))
    assert got == [(0, 0, "none", 2), (3, 0, "markdown", 9)]
    assert C.plan(docs.where(F.lit(False))).count() == 0


def test_a_shard_tells_its_best_alone(spark, tmp_path, monkeypatch):
    """What leaves a shard is k rows a query, however many chunks hold its words; equal texts tie in every shard."""
    monkeypatch.setattr(index, "SLICE", 200)
    rows = [(k, f"alpha beta{k % 3} gamma delta") for k in range(300)]
    path, asked = str(tmp_path / "index"), spark.createDataFrame([(1, ["alpha", "gamma"]), (2, ["beta1", "alpha"])], "query_id long, terms array<string>")
    index.build(frame(spark, rows), path, "a")
    said = index.load(spark, path)
    assert said["shards"] == [6]
    of, n = index._asked(spark, path, said, asked)
    told = index._summed_up(spark, path, said, index._held(spark, path, said, of), of, n, None, 4).collect()
    assert 2 * 4 <= len(told) <= 2 * 4 * 6
    got = [(r["query_id"], r["chunk_id"]) for r in index.search_top(spark, path, asked, 4).orderBy("query_id", "rank").collect()]
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 4), (2, 7), (2, 10)]


def test_cached_terms_are_those_of_words(spark):
    texts = ["a  b\ta\n", "  x \x1c y\x0b\x0cz ", "", "  \x85 \x85", "é é É"]
    rows = index._split(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts * 2)], "h string, text string").withColumn("h", F.md5("text"))).collect()
    want = spark.createDataFrame([(t,) for t in texts], "text string").select(F.md5("text").alias("h"), index.words(F.col("text")).alias("w")).collect()
    count = lambda w: {x: w.count(x) for x in w}
    assert len(rows) == len(texts)
    assert {r["h"]: (r["dl"], dict(zip(r["terms"].split(" "), r["tfs"], strict=False)) if r["tfs"] else {}) for r in rows} == {r["h"]: (len(r["w"]), count(r["w"])) for r in want}
