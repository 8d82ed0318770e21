"""Queries over all of their rows, against brute force on literal rows."""

import random

from tessera import registry


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_items_meet_documents_of_every_id(spark, tmp_path):
    passage = "Ein längerer Absatz, der für die Prüfung in mehreren Texten steht."
    middle = passage[len(passage) // 2 - 15 :][:30]
    items = [(1, passage), (2, "nowhere to be found in any of these texts at all"), (3, "short one"), (4, "tiny"), (5, None), (6, "a passage of its own, long enough for the key")]
    texts = [(2, f"x {passage} y"), (7, f"..{middle}.."), (41, passage), (44, "a short one, tiny"), (50, None), (51, ""), (52, passage[:20]), (53, "tin"), (54, "y short on")]
    d = put(spark, tmp_path, benchmark=(items, "item_id long, text string"), documents=(texts, "doc_id long, text string"))
    cut = lambda t: t if len(t) < 30 else t[len(t) // 2 - 15 :][:30]
    count = lambda x: sum(x in t for _, t in texts if t is not None)
    want = {i: (0, 0) if t is None else (count(t), count(cut(t))) for i, t in items}
    got = {r["item_id"]: (r["whole"], r["middle"]) for r in registry.queries()["ctx_hit"](spark, d).collect()}
    assert got == want and want[1] == (2, 3) and want[3] == want[4] == (1, 1)


def test_every_source_asks_with_32_chunks(spark, tmp_path):
    rng, sizes = random.Random(5), {"src0": 3, "src4": 32, "src5": 33, "src6": 100, "src9": 40}
    docs = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k, _ in docs]
    d = put(spark, tmp_path, documents=(docs, "doc_id long, source string"), embeddings=(vectors, "vec_id long, embedding array<double>"))
    of = {s: [v for k, v in vectors if docs[k][1] == s] for s in sizes}
    picked = {s: range(n) if n <= 32 else [k * n // 32 for k in range(32)] for s, n in sizes.items()}
    best = lambda q, b: max(round(sum(x * y for x, y in zip(q, v, strict=True)), 6) for v in of[b])
    want = {(a, b): sum(best(of[a][i], b) for i in picked[a]) / len(picked[a]) for a in sizes for b in sizes if a != b}
    got = {(r["a"], r["b"]): r["score"] for r in registry.queries()["similar_docs"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    pairs = registry.queries()["similar_pairs"](spark, d).collect()
    first = {(r["a"], r["b"]): r["s"] for r in pairs if r["k"] == 1}
    assert first == {(a, b): max(best(of[a][i], b) for i in picked[a]) for a, b in want}
