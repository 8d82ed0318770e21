"""Models handed in as functions, and metadata brought in line, on literal rows."""

import numpy as np

from tessera.operators.incremental import reconciled
from tessera.operators.models import embedded, hashed_words, pooled, scored


def test_pooling_leaves_padding_out():
    hidden = np.array([[[3.0, 0.0], [1.0, 4.0], [9.0, 9.0]], [[5.0, 5.0]] * 3], np.float32)
    assert np.allclose(pooled(hidden, np.array([[1, 1, 0], [0, 0, 0]])), [[0.70710678, 0.70710678], [0, 0]])


def test_embedding_does_not_hang_on_batches(spark):
    texts = [(k, t) for k, t in enumerate(["one two", "two one", None, "", "three words here", "one two"])]
    rows = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    of = [{r["id"]: r["embedding"] for r in embedded(rows, hashed_words, batch=b).collect()} for b in (1, 4, 32)]
    assert of[0] == of[1] == of[2] and of[0][0] == of[0][1] == of[0][5] and not any(of[0][2]) and not any(of[0][3])
    assert abs(sum(x * x for x in of[0][4]) - 1) < 1e-6


def test_scores_of_pairs(spark):
    pairs = spark.createDataFrame([("A b a", "x a", 1), ("a b", None, 2), (None, "a", 3), ("", "", 4), ("a", "A", 5)], "query string, text string, n int")
    assert {r["n"]: r["score"] for r in scored(pairs).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0}
    longer = lambda: lambda q, t: [len(a) - len(b) for a, b in zip(q, t, strict=True)]
    assert {r["n"]: r["score"] for r in scored(pairs, longer).collect()} == {1: 2.0, 2: 3.0, 3: -1.0, 4: 0.0, 5: 0.0}


def test_metadata_is_brought_in_line(spark):
    wanted = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "4"), ("d", "4"), (None, "5")], "doc_path string, content_hash string")
    held = spark.createDataFrame([("b",), ("b",), ("c",), ("x",), (None,)], "doc_path string")
    bodies = spark.createDataFrame([("b", "2"), ("d", "old"), ("x", "9")], "doc_path string, content_hash string")
    got = sorted(tuple(r) for r in reconciled(wanted, held, bodies).collect())
    assert got == [("a", "body"), ("a", "fill"), ("d", "body"), ("d", "fill"), ("x", "prune")]
