"""Steps that must grow no faster than their input."""

import time

from tessera import registry
from tessera.operators import models, scanning


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_sentences_of_a_long_tail(spark, tmp_path):
    """A text without an end mark takes time in proportion to its length."""
    rows = [(1, "a b" * 300_000), (2, "One. Two?! three"), (3, ""), (4, "...")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r["doc_id"]: r["sentences"] for r in registry.queries()["sentence_split"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: 1} and time.time() - began < 60


def test_groups_of_no_item_stay_where_they_are_read(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x y"), (3, "z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "q a b c d e f g h"), (2, "x y"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["gram_coverage"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 0.5), (2, 1, 1.0), (3, 1, 0.0)]
    assert "LeftSemi, BuildRight" in plan_of(found, capsys)


def test_pages_of_boxes_move_as_texts(spark, tmp_path, capsys):
    text = " ".join(f"w{k}" for k in range(305))
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "only")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["ocr_rows"](spark, str(tmp_path))
    assert sorted((r["doc_id"], r["page"], r["n_rows"]) for r in found.collect()) == [(1, 0, 38), (1, 1, 1), (4, 0, 1)]
    assert "posexplode" not in plan_of(found, capsys)


def test_texts_are_encoded_some_at_a_time(spark):
    texts = spark.range(600).selectExpr("id", "concat('w', id) AS text").coalesce(1)
    sizes = texts.select("id", "text").mapInArrow(lambda parts: (b.select(["id"]) for b in parts), "id long").count()
    assert models.embedded(texts, models.hashed_words, batch=1).count() == sizes == 600 and models.TEXTS < sizes


def python_rows(df) -> int:
    """Rows that Python gave to the plan of a collected df."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        own = node.metrics().get("pythonNumRowsReceived")
        return (own.get().value() if own.isDefined() else 0) + sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_of_an_answer_are_counted_where_they_are_read(spark):
    """What leaves the tasks follows the answers and their sources, not the texts that hold them."""
    cases = spark.createDataFrame([(k, ["s0", "s1"], ["a|b", "c"]) for k in range(5)], "case_id long, sources array<string>, must array<string>")
    for n in (300, 3000):
        docs = spark.range(0, n, 1, 2).selectExpr("concat('s', id % 3) AS source", "id AS doc", "'a b c' AS text")
        checked = scanning.cases_checked(cases, docs)
        assert {tuple(r)[1:] for r in checked.collect()} == {(2, 2, 0, 2, "common")}
        assert 0 < python_rows(checked) <= 2 * 2 * 3
