"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans.dialect import DUCK, SPARK, run

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def sql(make: Callable) -> Callable:
    """Register a query given as one text for both dialects; make.__name__ is its key."""
    _QUERIES[make.__name__] = lambda spark, sf_dir: run(spark, sf_dir, make(SPARK))
    _ORACLES[make.__name__] = make(DUCK)
    return make


def frame(oracle: str | None = None) -> Callable:
    """Register a query given as a function (spark, sf_dir) -> DataFrame, with its oracle if SQL has one."""

    def put(make: Callable) -> Callable:
        _QUERIES[make.__name__] = make
        if oracle:
            _ORACLES[make.__name__] = oracle
        return make

    return put


def _load() -> None:
    from tessera.functions import answers, metadata, people, phrases, text  # noqa: F401
    from tessera.operators import chunk_plan, chunking, evaluation, finding, incremental, index, models, passages, renormalise, retrieval, rewriting, rules, scanning, sections, selection, sequential, vector_table, versions  # noqa: F401
    from tessera.sources import edges, files, parsing, properties, scanned  # noqa: F401
    from tessera.streaming import history, rescan, windows  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
