"""Dedup and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: str, order_col: str, nulls: str = "collapse") -> DataFrame:
    """Keep the first row (smallest ``order_col``) per ``key``.

    ``min_by(struct(*), order)`` is a declarative aggregate, so it runs as a
    hash aggregate with a map-side partial step: a key holding a third of the
    rows is reduced inside every task before the shuffle, and the kept row is
    deterministic (``dropDuplicates`` keeps an arbitrary one).
    ``nulls='collapse'`` treats all null keys as one key (as pandas does);
    ``nulls='keep'`` keeps every null-key row.
    """
    cols = df.columns
    src = df if nulls == "collapse" else df.where(F.col(key).isNotNull())
    first = (src.groupBy(key)
             .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col)).alias("_r"))
             .select(*[F.col("_r")[c].alias(c) for c in cols]))
    if nulls == "keep":
        first = first.unionByName(df.where(F.col(key).isNull()))
    return first


def union_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenate by column name; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def stack_embeddings(tables: Sequence[tuple[str, DataFrame]], id_col: str = "id",
                     vec_col: str = "embedding", domain_col: str = "domain") -> DataFrame:
    """D3: stack keyed vector tables, tagging each with its domain (P10)."""
    return union_sources([t.select(id_col, vec_col).withColumn(domain_col, F.lit(name))
                          for name, t in tables])


def tag_domain(df: DataFrame, name: str, domain_col: str = "domain") -> DataFrame:
    """P10: constant label per source."""
    return df.withColumn(domain_col, F.lit(name))
