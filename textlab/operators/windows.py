"""Window-shaped logic, ordering and top-k.

Windows are always partitioned by a key whose groups are bounded (a batch, a
block of a trial, a (target, class) pair) or pruned by a group limit first.
Unbounded groups are split into blocks and stitched with a small prefix table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_best(df: DataFrame, group_col: str, order_col: str, metric_col: str,
                 block: int = 4096, out_col: str = "is_best") -> DataFrame:
    """``is_best = metric >= max(previous metrics of the group)``.

    A group may hold a third of all rows, so it is cut into blocks of
    ``block`` consecutive rows (by position, whatever the order values are). (1) max per (group, block): n / block
    rows; (2) prefix max of earlier blocks with a window over that small
    table; (3) within-block running max with a window partitioned by
    (group, block). No task ever sees more than one block of a group.
    The first non-null value is a best; a null metric is never a best.
    """
    x = group_row_number(df, [group_col], [order_col], "_rn")
    x = x.withColumn("_blk", F.floor((F.col("_rn") - 1) / F.lit(block)).cast("bigint"))
    bm = x.groupBy(group_col, "_blk").agg(F.max(metric_col).alias("_bmax"))
    prior = bm.withColumn(
        "_prior", F.max("_bmax").over(Window.partitionBy(group_col).orderBy("_blk")
                                      .rowsBetween(Window.unboundedPreceding, -1))
    ).select(F.col(group_col).alias("_pg"), F.col("_blk").alias("_pb"), "_prior")
    w_in = (Window.partitionBy(group_col, "_blk").orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_within", F.max(metric_col).over(w_in))
    y = (x.join(prior, x[group_col].eqNullSafe(prior["_pg"]) & (x["_blk"] == prior["_pb"]), "left")
         .drop("_pg", "_pb"))
    prev = F.greatest(F.col("_prior"), F.col("_within"))
    m = F.col(metric_col)
    return (y.withColumn("prev_best", prev)
            .withColumn(out_col, m.isNotNull() & (prev.isNull() | (m >= prev)))
            .drop("_blk", "_within", "_prior", "_rn"))


def _range_slices(df: DataFrame, n: int | None, group_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Range-partition by (group, order), sort inside each slice and number the rows of the slice
    (``_pid`` the slice, ``_at`` the 0-based place in it), then stage the result in the shared folder.

    ``monotonically_increasing_id`` carries both numbers, so rows never leave the JVM. Staging fixes the
    slicing: Spark's range partitioner samples with a seed tied to the RDD id, so two reads of an
    unmaterialised range exchange may disagree. Without ``n`` the slices follow the measured bytes
    (AQE joins small ones up to its advisory size).
    """
    from textlab.session import stage
    keys = [*group_cols, *order_cols]
    r = df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    r = stage(r.sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "slices")
    return (r.withColumn("_pid", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
            .drop("_id"))


def row_index(df: DataFrame, order_cols: Sequence[str], out_col: str = "idx",
              n_parts: int | None = None) -> DataFrame:
    """Dense 0-based position in ``order_cols`` order (unique key).

    Like ``zipWithIndex`` but on DataFrames: range-partition by the key and
    number rows inside each slice in the same pass, count rows per slice (a
    tiny table), prefix-sum those counts and add them (broadcast). One
    shuffle, no single-partition window.
    """
    r = _range_slices(df, n_parts, [], order_cols)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).select("_pid", "_off")
    return (r.join(F.broadcast(offs), "_pid")  # one row per slice
            .withColumn(out_col, (F.col("_off") + F.col("_at")).cast("bigint"))
            .drop("_pid", "_off", "_at"))


def group_row_number(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                     out_col: str = "rn", n_parts: int | None = None) -> DataFrame:
    """1-based position inside each group, in ``order_cols`` order (unique
    within the group), without putting a whole group in one task.

    Range-partition by (group, order): a group holding a third of the rows
    spans many slices. Rows are numbered per group inside each slice in the
    same pass; rows per (group, slice) are counted (at most groups + slices
    rows), prefix-summed per group and added back with a join on
    (group, slice), which AQE broadcasts when that table is small.
    """
    r = _range_slices(df, n_parts, group_cols, order_cols)
    # a group's rows are together in a slice: its first place there makes the numbers start at 1
    counts = r.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_n")
    o = offs.select(*[F.col(g).alias(f"_o_{g}") for g in group_cols], F.col("_pid").alias("_o_pid"), "_off", "_first")
    cond = [r[g].eqNullSafe(o[f"_o_{g}"]) for g in group_cols] + [r["_pid"] == o["_o_pid"]]  # null keys too
    return (r.join(o, cond)
            .withColumn(out_col, (F.col("_off") + F.col("_at") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_off", "_at", "_first", "_o_pid", *[f"_o_{g}" for g in group_cols]))


def cumulative_sum(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
                   prefix: str = "cum_", n_parts: int | None = None) -> DataFrame:
    """Running totals over the whole table in ``order_cols`` order without a
    single-partition window: per range partition totals (one row each) are
    prefix-summed and broadcast, then each partition sums its own rows."""
    r = _range_slices(df, n_parts, [], order_cols)
    tot = r.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wp), F.lit(0)).alias(f"_o_{c}")
                                for c in value_cols])
    w = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    out = r.join(F.broadcast(offs), "_pid")
    for c in value_cols:
        out = out.withColumn(prefix + c, (F.col(f"_o_{c}") + F.sum(c).over(w)).cast("bigint"))
    return out.drop("_pid", "_at", *[f"_o_{c}" for c in value_cols])


def group_cumulative_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                         value_cols: Sequence[str], prefix: str = "cum_", n_parts: int | None = None) -> DataFrame:
    """Running totals inside each group in ``order_cols`` order (unique within the group), without putting a whole
    group in one task: totals of (group, slice) are prefix-summed per group and added to the sums inside the slice."""
    r = _range_slices(df, n_parts, group_cols, order_cols)
    tot = r.groupBy(*group_cols, "_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    wp = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(g).alias(f"_o_{g}") for g in group_cols], F.col("_pid").alias("_o_pid"),
                      *[F.coalesce(F.sum(f"_t_{c}").over(wp), F.lit(0)).alias(f"_c_{c}") for c in value_cols])
    w = Window.partitionBy(*group_cols, "_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    cond = [r[g].eqNullSafe(offs[f"_o_{g}"]) for g in group_cols] + [r["_pid"] == offs["_o_pid"]]
    out = r.join(offs, cond)
    for c in value_cols:
        out = out.withColumn(prefix + c, (F.col(f"_c_{c}") + F.sum(c).over(w)).cast("bigint"))
    return out.drop("_pid", "_at", "_o_pid", *[f"_o_{g}" for g in group_cols], *[f"_c_{c}" for c in value_cols])


def batch_examples(df: DataFrame, idx_col: str, label_col: str = "label", batch_size: int = 100,
                   per_label: int = 3) -> DataFrame:
    """In each *full* batch of ``batch_size`` rows, the first ``per_label``
    rows of each label. The last partial batch gives nothing."""
    n = df.agg(F.count(F.lit(1)).alias("_n")).scalar()  # scalar subquery
    x = (df.withColumn("batch", F.floor(F.col(idx_col) / batch_size).cast("bigint"))
         .where(F.col("batch") < F.floor(n / batch_size)))
    w = Window.partitionBy("batch", label_col).orderBy(idx_col)
    return (x.where(F.col(label_col).isNotNull())
            .withColumn("pick", F.row_number().over(w))
            .where(F.col("pick") <= per_label))


def cumulative_progress(df: DataFrame, idx_col: str, label_col: str = "label",
                        batch_size: int = 100) -> DataFrame:
    """Running totals per label after each batch of ``batch_size`` rows.

    Counts are taken per batch first (n / batch_size rows), then summed
    cumulatively with the partitioned prefix sum (no single-task window).
    """
    per = df.groupBy(F.floor(F.col(idx_col) / batch_size).cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label_col) == 1).alias("positives"),
        F.count_if(F.col(label_col) == 0).alias("negatives"),
        F.count_if(F.col(label_col).isNull()).alias("nulls"))
    cols = ["rows", "positives", "negatives", "nulls"]
    return cumulative_sum(per, ["batch"], cols).select("batch", *[f"cum_{c}" for c in cols])


def head(df: DataFrame, n: int, order_cols: Sequence[str]) -> DataFrame:
    """First ``n`` rows in key order (TakeOrderedAndProject: top-n per task)."""
    return df.orderBy(*order_cols).limit(n)


def topk_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence, k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per group. ``row_number() <= k`` lets Catalyst insert
    a partial WindowGroupLimit before the shuffle, so a hot group sends at most
    ``k`` rows per task."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def sort_by_metric(df: DataFrame, metric: str = "f1", tie: str = "model") -> DataFrame:
    """Sort by a metric, descending, then by name."""
    return df.orderBy(F.desc(metric), F.asc(tie))
