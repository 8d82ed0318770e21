"""Queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera import registry

D = "/root/testdata/sf0.001"
CHECKED = ["bm25_topk", "dense_topk", "hybrid_search", "chunk_fixed", "find_docs", "plan_changes", "meta_relax", "mcnemar", "debounce_sessions", "folder_scope"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(D):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{D}/{name}'")
    return c


def rows(table):
    tidy = lambda v: round(float(v), 5) if hasattr(v, "as_tuple") or isinstance(v, float) else v
    return sorted(str(tuple(tidy(r[k]) for k in sorted(r))) for r in table.to_pylist())


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    assert rows(registry.queries()[name](spark, D).toArrow()) == rows(duck.sql(registry.oracles()[name]).to_arrow_table())


def test_folder_never_takes_in_its_longer_namesake(spark):
    paths = [r["doc_path"] for r in registry.queries()["folder_scope"](spark, D).collect()]
    assert paths and all("/src1/" in p for p in paths)
