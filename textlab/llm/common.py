"""Shared helpers: bounded samples in hash order, safe inputs, literal arrays."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.session import ensure_checkpoint_dir, made


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def hash_sample(df: DataFrame, key: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of ``df``: those whose key hash is smallest.

    Two narrow passes: the n-th smallest hash is found on the key columns alone, then the rows
    under it are read. Rows with one and the same key share a hash, so a final ``limit`` keeps
    the bound when a single key holds most rows.
    """
    h = F.xxhash64(*key)
    cut = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if cut is None:
        return df.limit(0)
    return df.filter(h <= F.lit(cut)).limit(n)


def double_array(values: list[float]) -> Column:
    """A constant ``array<double>`` column, folded to one literal by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def bucketed(df: DataFrame, key: str, name: str, spread: bool = True, parts: int | None = None) -> DataFrame:
    """``df`` staged in the shared folder as a table bucketed by ``key``: joins on the key then move only
    the other side. With ``spread`` rows are first dealt out by key, which leaves one file per bucket. ``parts``
    is the number of buckets (by default that of shuffle partitions)."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{name}_{uuid.uuid4().hex}"
    path = os.path.join(ensure_checkpoint_dir(spark), "stages", name)
    made("path", path)
    made("table", name)
    (df.repartition(parts, key) if spread else df).write.format("parquet").option("compression", "zstd") \
        .option("path", path).bucketBy(parts, key).saveAsTable(name)
    return spark.table(name)


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers are kept for later tasks."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
