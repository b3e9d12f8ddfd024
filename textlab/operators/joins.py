"""Key joins (E1, E2, E4, E6, E7) and the parameter grid (E5)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.dedup import union_sources

log = logging.getLogger(__name__)


def attach_cluster_label(rows: DataFrame, clusters: DataFrame, key: str,
                         cluster_col: str = "cluster") -> DataFrame:
    """Attach clusters by key (not by row position) and set ``label = 1 - cluster``."""
    return (rows.join(clusters.select(key, cluster_col), key, "inner")
            .withColumn("label", (F.lit(1) - F.col(cluster_col)).cast("int")))


def pending_rows(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not yet in ``done`` (left anti join)."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resume_merge(done: DataFrame, new: DataFrame) -> DataFrame:
    """Done rows are kept; new rows are appended."""
    return done.unionByName(new, allowMissingColumns=True)


def predictions_vs_labels(pred: DataFrame, labels: DataFrame, key: str,
                          label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """E4 + P15: predictions matched to labels by key, with ``correct``."""
    return (pred.join(labels.select(key, label_col), key, "inner")
            .withColumn("correct", F.col(label_col) == F.col(pred_col)))


def param_grid(spark: SparkSession, grid: Mapping[str, Sequence], fixed: Mapping | None = None) -> DataFrame:
    """E5: Cartesian product of the grid lists, one row per trial.

    ``trial`` numbers follow ``itertools.product`` order (the last key varies
    fastest). Built with ``posexplode`` over literal arrays, so no join runs.
    """
    keys = list(grid)
    df = spark.range(1).select()
    for k in keys:
        vals = [F.lit(v) for v in grid[k]]
        df = df.select("*", F.posexplode(F.array(*vals)).alias(f"_i_{k}", k))
    stride = 1
    trial = F.lit(0)
    for k in reversed(keys):
        trial = trial + F.col(f"_i_{k}") * F.lit(stride)
        stride *= len(grid[k])
    df = df.withColumn("trial", (trial + 1).cast("int"))
    for k, v in (fixed or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df.select("trial", *keys, *(fixed or {}).keys()).orderBy("trial")


def score_models(eval_df: DataFrame, scorers: Mapping[str, Callable[[DataFrame], DataFrame]],
                 key: str, label_col: str = "label", pred_col: str = "prediction"):
    """Every scorer over the same eval set, as one long table
    ``(model, key, label, prediction)``. Each scorer's predictions are written to
    the shared stage folder in a job of their own, so one that fails, while its
    plan is built or while it runs, is skipped and reported; the others go on."""
    from textlab.session import stage
    parts, skipped = [], []
    for name, fn in scorers.items():
        try:
            out = fn(eval_df)
            parts.append(stage(out.select(F.lit(name).alias("model"), key, label_col,
                                          F.col(pred_col).cast("int").alias(pred_col)), "scores"))
        except Exception as e:  # noqa: BLE001 - isolation is the point
            log.warning("scorer %s skipped: %s", name, e)
            skipped.append((name, str(e)))
    if not parts:
        raise ValueError("no scorer produced predictions")
    return union_sources(parts), skipped


def exclude_selected(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows not already chosen (left anti join by key)."""
    return df.join(selected.select(key), key, "left_anti")
