"""Counting aggregates: value counts (G1), shares (G2), crosstab (G3), load
report (G4), progress summary (G5), bincount (G20), quadrant report (G21).

All are one ``groupBy`` with a map-side partial aggregate, so a hot value is
pre-counted in every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import is_blank


def value_counts(df: DataFrame, col: str, sort: str = "count") -> DataFrame:
    """G1: rows per value (nulls counted as their own value)."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if sort == "count":
        return out.orderBy(F.desc("n"), F.asc_nulls_first(col))
    return out.orderBy(F.asc_nulls_first(col))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Normalised counts; the total is a sum over the counts (one row per value)."""
    from pyspark.sql import Window
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def crosstab(df: DataFrame, row_col: str, col_col: str, values: Sequence) -> DataFrame:
    """Two-key count unstacked over fixed ``values``, zero-filled.

    Fixed pivot values avoid the extra distinct-values job and keep the output
    schema stable.
    """
    out = df.groupBy(row_col).pivot(col_col, list(values)).agg(F.count(F.lit(1)))
    for v in values:
        out = out.withColumn(str(v), F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint"))
    return out


def load_report(df: DataFrame, file_col: str, text_col: str, label_col: str,
                with_total: bool = True) -> DataFrame:
    """Per file, rows loaded / kept after cleaning / removed, label counts,
    plus a totals row (``file_col`` null) from the same aggregation
    (``rollup``), so the data is read once.

    ``file_col`` is usually ``_metadata.file_path`` captured at the scan.
    Rows are kept when the text is not blank and the label parses.
    """
    from textlab.functions.text import cast_label
    lab = cast_label(label_col)
    kept = ~is_blank(text_col) & lab.isNotNull()
    g = df.rollup(file_col) if with_total else df.groupBy(file_col)
    return g.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("removed"),
        F.count_if(kept & (lab == 1)).alias("positives"),
        F.count_if(kept & (lab == 0)).alias("negatives"),
    )


def progress_summary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Total, positives, negatives, nulls and their percentages (one row)."""
    lab = F.col(label_col)
    c = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(lab == 1).alias("positives"),
               F.count_if(lab == 0).alias("negatives"),
               F.count_if(lab.isNull()).alias("nulls"))
    pct = lambda x: F.round(F.coalesce(F.try_divide(100.0 * F.col(x), F.col("total")), F.lit(0.0)), 6)
    return c.select("total", "positives", "negatives", "nulls",
                    pct("positives").alias("pct_positives"),
                    pct("negatives").alias("pct_negatives"),
                    pct("nulls").alias("pct_nulls"))


def bincount(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows per id in 0..k-1, zeros included (dense frame left join)."""
    spark = df.sparkSession
    dense = spark.range(k).select(F.col("id").cast("int").alias(col))
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return (dense.join(counts, col, "left")
            .select(col, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def quadrant_report(df: DataFrame, cluster_col: str = "cluster",
                    label_col: str = "original_label") -> DataFrame:
    """Rows per (cluster, original label) over the dense 2 x 2 frame,
    with the grand total and an ``empty`` flag for missing quadrants."""
    spark = df.sparkSession
    dense = spark.createDataFrame([(c, l) for c in (0, 1) for l in (0, 1)],
                                  f"{cluster_col} int, {label_col} int")
    counts = df.groupBy(cluster_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    out = (dense.join(counts, [cluster_col, label_col], "left")
           .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))
    return (out.withColumn("total", F.sum("n").over(Window.partitionBy()).cast("bigint"))
            .withColumn("empty", F.col("n") == 0)
            .withColumn("quadrant", F.when(F.col(cluster_col) == F.col(label_col) * -1 + 1, "pattern")
                        .otherwise("exception")))
