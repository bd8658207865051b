"""All registered queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that the whole library serves: which documents answer a vector."""
    return QUERIES["vector_topk_docs"](spark, sf_dir)


from tessera.plans import answers, curation, graph, ingestion, relations, reporting, retrieval, scalars, sources, subgraph  # noqa: E402,F401  these register their queries
