"""The pipeline's stages, each against what it is to do on its own input."""

import corpus_pipeline as P
from test_corpus_operators import WORD, brute_lines, rows_of

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, words = docs.columns, None
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, D).write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        if name == "best_fit_packing":
            assert docs.groupBy().sum("length").first()[0] == words
            continue
        assert docs.columns == columns
        rows = rows_of(docs)
        words = sum(len(WORD.findall(t or "")) for _, t in rows)
        ids = [i for i, _ in rows]
        if name == "line_dedup":
            had = dict(rows_of(before))
            lost = brute_lines(list(had.items()))
            assert all(len(had[i].split("\n")) - len(t.split("\n")) == lost[i][1] for i, t in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "simhash_near_dedup":
            assert len(set(t for _, t in rows)) == len(rows) == len(set(ids))
            assert {t for _, t in rows} <= {t for _, t in rows_of(before)}
        if name == "source_mixing":
            assert set(ids) <= {i for i, _ in rows_of(before)}


def test_run(spark):
    assert P.run(spark, D).count() > 0


def test_stages_on_odd_rows(spark):
    """Nulls, repeated and null ids, empty texts, columns named as the stages' own, an empty table."""
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(40)
    more = docs.selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "source", "n_chars").limit(10).union(docs.limit(5))
    text = " ".join(f"sentence number {k} tells of something else," for k in range(40))
    odd = spark.createDataFrame([(None, text, None, None, None), (None, text[::-1], "en", "s", 1), (7, None, None, None, 0), (8, "", "en", "s", 0), (None, None, None, None, None)], docs.schema)
    clash = ["n_lines", "n_dropped", "batch_no", "key", "node", "shard", "size", "component_id"]
    docs = docs.union(more).union(odd).selectExpr("*", *(f"'{x}' AS {x}" for x in clash))
    rows, names = docs, docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before, rows = rows, stage(spark, rows, D)
        if k < len(P.STAGES) - 1:
            assert rows.columns == names
            assert rows.where("key <> 'key' OR n_lines <> 'n_lines'").count() == 0
        if name == "simhash_near_dedup":
            texts = {r["text"] for r in before.collect()} - {None, ""}
            kept = [r["text"] for r in rows.collect()]
            assert len(kept) == len(set(kept)) and (text not in texts or text in kept)
    empty = docs.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, empty, D).count() == 0
