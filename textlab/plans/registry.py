"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
given tables. Column names and types match the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textlab.plans import oracles as O
from textlab.plans.audit import cluster_domain_crosstab

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


register("cluster_domain_crosstab", O.flagship_sql())(cluster_domain_crosstab)


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from textlab.plans import queries_basic  # noqa: F401
    from textlab.plans import queries_metrics  # noqa: F401
    from textlab.plans import queries_sampling  # noqa: F401
    from textlab.plans import queries_text  # noqa: F401
    from textlab.plans import queries_vectors  # noqa: F401
    from textlab.plans import queries_trials  # noqa: F401
    from textlab.plans import queries_models  # noqa: F401
    from textlab.plans import queries_streaming  # noqa: F401
    from textlab.plans import queries_sources  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
