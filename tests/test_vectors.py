"""Vector search in cells against brute force."""

import numpy as np

from tessera import registry
from tessera.operators import vectors as V


def cells(monkeypatch):
    for name, x in (("PART_ROWS", 40), ("BLOCK_ROWS", 5), ("SCORES", 64)):
        monkeypatch.setattr(V, name, x)
    whole = V.in_cells
    monkeypatch.setattr(V, "in_cells", lambda v, q, cell, schema: whole(v, q, cell, schema, 40, 5))


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "chunk_id long, v array<float>, doc string"), spark.createDataFrame(asked, "query_id long, q array<float>")


def test_doc_max_of_many_cells_equals_pairs(spark, monkeypatch):
    cells(monkeypatch)
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(-2, 3, 3).astype(float).tolist(), None if k % 17 == 0 else f"d{0 if k % 3 == 0 else k % 11}") for k in range(200)]
    rows += [(500, None, "d1"), (501, [1.0, 2.0], "d2"), (502, [0.0, 1.0], "only")]
    asked = [(k, rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(0, 600, 50)] + [(700, [1.0, 1.0]), (701, None)]
    v, q = frames(spark, rows, asked)
    want = {}
    for i, x in asked:
        for c, y, doc in rows:
            if x is not None and y is not None and len(x) == len(y):
                want.setdefault((i, doc), []).append((-float(np.dot(x, y)), c))
    told = {k: (-sorted(s)[0][0], sorted(s)[0][1], -sorted(s)[1][0] if len(s) > 1 else None, len(s)) for k, s in want.items()}
    got = V.doc_max(v, q).collect()
    assert {(r["query_id"], r["doc"]): (r["best"], r["chunk_id"], r["second"], r["n"]) for r in got} == told and len(got) == len(told)
    top = {(r["query_id"], r["rank"]): r["chunk_id"] for r in V.ranked(V.nearest(v, q, 3), 3).collect()}
    of = {i: [c for _, c in sorted(s for (j, _), own in want.items() if j == i for s in own)] for i, _ in asked}
    assert top == {(i, k + 1): c for i, own in of.items() for k, c in enumerate(own[:3])}
    assert V.doc_max(v.where("false"), q).collect() == [] and V.nearest(v, q.where("false"), 3).collect() == []


def test_no_pairs_in_the_plans(spark):
    for name in ("doc_max_scan", "find_docs", "find_pages", "similar_docs", "similar_pairs", "synonym_suggest", "dense_topk", "dense_pending"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
