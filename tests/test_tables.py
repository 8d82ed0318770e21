"""The vector table under crashes, and versions of documents against brute force."""

import collections
import math
import random

import pytest

from tessera.operators import vector_table as T
from tessera.operators import versions as V
from tessera.sources import manifest


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, doc string, v array<float>")


def held(table):
    return {r["chunk_id"]: (r["doc"], None if r["v"] is None else tuple(r["v"])) for r in table.read().collect()}


def test_changes_replay_as_a_dictionary(spark, tmp_path):
    rng, table, want = random.Random(2), T.VectorTable(spark, str(tmp_path / "t")), {}
    assert held(table) == {} and table.fill_pending(lambda x: x) == 0
    for step in range(6):
        own = {k: (f"d{k % 3}", (float(step), float(k))) for k in rng.sample(range(40), 15)}
        table.upsert(rows_of(spark, [(k, d, list(v)) for k, (d, v) in own.items()]))
        want |= own
        gone = rng.sample(range(50), 4)
        table.delete(spark.createDataFrame([(k,) for k in gone], "chunk_id long"))
        want = {k: x for k, x in want.items() if k not in gone}
        assert held(table) == want
    state = table.state()
    assert state["gone"] <= T.DEAD * state["rows"] and len(state["generations"]) < 6  # it was rebuilt on the way
    table.delete_doc(spark.createDataFrame([("d1",)], "doc string"), keep=spark.createDataFrame([(k,) for k in range(20)], "chunk_id long"))
    want = {k: x for k, x in want.items() if x[0] != "d1" or k < 20}
    table.set_payload(spark.createDataFrame([(k, "moved") for k in (1, 2, 3, 999)], "chunk_id long, doc string"))
    want = {k: ("moved", x[1]) if k in (1, 2, 3) else x for k, x in want.items()}
    assert held(table) == want and table.unused()
    with pytest.raises(ValueError):
        table.upsert(rows_of(spark, [(1, "a", None), (1, "b", None)]))
    assert held(table) == want


@pytest.mark.parametrize("when", ["files", "state"])
def test_a_change_cut_short_leaves_the_table(spark, tmp_path, monkeypatch, when):
    table = T.VectorTable(spark, str(tmp_path / "t"))
    table.upsert(rows_of(spark, [(k, "d", [float(k)]) for k in range(10)]))
    want = held(table)

    def lost(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(T.VectorTable, "_buried", lost) if when == "files" else m.setattr(manifest, "save", lost)
        for change in (lambda: table.upsert(rows_of(spark, [(1, "new", [9.0])])), lambda: table.delete(spark.createDataFrame([(2,)], "chunk_id long"))):
            with pytest.raises(OSError):
                change()
            assert held(table) == want
    table.upsert(rows_of(spark, [(1, "new", [9.0])]))
    assert held(table) == want | {1: ("new", (9.0,))}


def test_filling_goes_on_where_it_was(spark, tmp_path):
    table = T.VectorTable(spark, str(tmp_path / "t"))
    table.upsert(rows_of(spark, [(k, f"d{k % 4}", None if k % 2 else [0.0]) for k in range(60)]))
    seen = []

    def embed(step):
        ids = sorted((r["doc"], r["chunk_id"]) for r in step.collect())
        if len(seen) == 2:
            raise OSError("lost")
        seen.append(ids)
        return spark.createDataFrame([(k, [float(k)]) for _, k in ids if k != 7], "chunk_id long, v array<float>")

    with pytest.raises(OSError):
        table.fill_pending(embed, batches=2, batch=4)
    assert table.pending().count() == 30 - sum(len([k for _, k in s if k != 7]) for s in seen)
    filled = table.fill_pending(lambda s: s.where("chunk_id <> 7").selectExpr("chunk_id", "array(float(chunk_id)) AS v"), batches=2, batch=4)
    assert filled == 29 - sum(len([k for _, k in s if k != 7]) for s in seen)
    assert [r["chunk_id"] for r in table.pending().collect()] == [7]
    assert all(v is None if k == 7 else v == (float(k) if k % 2 else 0.0,) for k, (_, v) in held(table).items())


def test_versions_equal_pairs(spark):
    rng = random.Random(8)
    line = lambda k: f"line number {k} of the corpus, long enough to be a key"
    texts = ["\n".join(line(min(int(rng.paretovariate(0.4)), 200)) for _ in range(rng.randrange(1, 14))) for _ in range(120)]
    texts += [texts[3], texts[3], line(1), line(1) + "\nshort", line(1) + "\n" + line(9000), "short", "", line(1).replace(" ", "\t"), None, None]
    docs = spark.createDataFrame([(k + 5, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keys = {k + 5: {"".join(x.split()) for x in t.split("\n") if len("".join(x.split())) >= 40} for k, t in enumerate(texts) if t is not None}
    text = {k + 5: t for k, t in enumerate(texts)}
    want = {}
    for i, t in text.items():
        if t is None:
            want[i] = (0, 0, 0)
            continue
        m = math.ceil(0.2 * len(keys[i]) - 1e-9)
        versions = sum(text[j] != t and len(keys[i] & keys[j]) >= m and bool(keys[i]) for j in keys)
        want[i] = (len(keys[i]), sum(text[j] == t for j in keys) - 1, versions)
    got = {r["doc_id"]: r for r in V.versions(docs).collect()}
    assert {i: (r["n_keys"], r["n_copies"], r["n_versions"]) for i, r in got.items()} == want
    often = {x for x, n in collections.Counter(x for t in set(text.values()) - {None} for x in keys[next(i for i in text if text[i] == t)]).items() if n > 1}
    groups = collections.defaultdict(set)
    for i in keys:
        groups[frozenset(keys[i] & often) or text[i]].add(i)
    assert all(got[i]["class_id"] == min(own) for own in groups.values() for i in own)
    assert V.versions(docs.where("false")).collect() == []
