"""Splits, samples and shuffles (Q1-Q6, Q8, Q12).

"Random" means the md5 hash order of ``textlab.functions.hashing``: results
do not depend on partitioning and DuckDB can repeat them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.hashing import hash_order
from textlab.operators.joins import exclude_selected
from textlab.operators.windows import topk_per_group


def class_quotas(counts: dict, frac) -> dict:
    """Q1 quotas: ``n_val = ceil(frac * n)``; class share ``floor(n_c * n_val / n)``;
    the remainder goes to the largest fractional parts, ties to the smaller
    label. Exact rational arithmetic (0.2 is 1/5, not 0.2000000001)."""
    fr = Fraction(str(frac))
    n = sum(counts.values())
    n_val = -((-n * fr.numerator) // fr.denominator)
    base = {c: (m * n_val) // n for c, m in counts.items()}
    rem = {c: (m * n_val) % n for c, m in counts.items()}
    left = n_val - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


#: Labels of a stratified split: their quotas are worked out on the driver and broadcast.
MAX_LABELS = 100_000


def stratified_split(df: DataFrame, label_col: str, key: str, frac=0.2, seed: int = 42,
                     prefix_len: int | None = None, out_col: str = "split",
                     bucket_rows: int = 100_000) -> DataFrame:
    """Q1: exact stratified train/val split in hash order.

    Per class the first ``quota`` rows in hash order go to ``val``. To avoid a
    window over a whole class, a histogram of hash prefixes per class
    (16^prefix_len bins) finds the boundary prefix; only the rows of that one
    bucket are ranked. The prefix length grows with the largest class so a
    bucket holds about ``bucket_rows`` rows (4 hex digits up to ~6.5e9 rows
    per class, then 5, ...); md5 prefixes are uniform, so no bucket is hot.
    """
    import math
    counts = {r[0]: int(r[1]) for r in df.groupBy(label_col).count().limit(MAX_LABELS + 1).collect()}
    if None in counts:
        raise ValueError("null label in stratified_split")
    if len(counts) > MAX_LABELS:
        raise ValueError(f"stratified_split takes at most {MAX_LABELS} labels; {label_col} has more")
    if prefix_len is None:
        biggest = max(counts.values(), default=1)
        prefix_len = max(4, min(8, math.ceil(math.log(max(biggest / bucket_rows, 1.0), 16))))
    quotas = class_quotas(counts, frac)
    spark = df.sparkSession
    q = spark.createDataFrame(list(quotas.items()), f"{label_col} {df.schema[label_col].dataType.simpleString()}, _quota long")
    x = (df.withColumn("_h", hash_order(key, seed, "split"))
         .withColumn("_pre", F.substring("_h", 1, prefix_len)))
    hist = x.groupBy(label_col, "_pre").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(label_col).orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    hist = (hist.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
            .join(F.broadcast(q), label_col))
    bounds = (hist.where((F.col("_before") < F.col("_quota")) &
                         (F.col("_before") + F.col("_cnt") >= F.col("_quota")))
              .select(label_col, F.col("_pre").alias("_b"), (F.col("_quota") - F.col("_before")).alias("_need")))
    # classes with quota 0 have no boundary bucket: everything is train
    y = x.join(F.broadcast(bounds), label_col, "left")
    inner = y.where(F.col("_pre") == F.col("_b"))
    rn = F.row_number().over(Window.partitionBy(label_col).orderBy("_h", key))
    inner = inner.withColumn("_val", rn <= F.col("_need"))
    outer = y.where(F.col("_b").isNull() | (F.col("_pre") != F.col("_b"))).withColumn(
        "_val", F.coalesce(F.col("_pre") < F.col("_b"), F.lit(False)))
    out = outer.unionByName(inner)
    return (out.withColumn(out_col, F.when(F.col("_val"), "val").otherwise("train"))
            .drop("_h", "_pre", "_b", "_need", "_val"))


def fast_split(df: DataFrame, key: str, frac=0.2, seed: int = 42, out_col: str = "split") -> DataFrame:
    """Q1 fast mode: hash fraction < frac -> val (no counts, approximate sizes)."""
    from textlab.functions.hashing import hfrac
    return df.withColumn(out_col, F.when(hfrac(F.lit(f"{seed}:split"), F.col(key)) < frac, "val")
                         .otherwise("train"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Q2: ``n`` rows without replacement (``min(n, rows)``): the first ``n``
    in hash order; a top-n per task, then a merge."""
    return (df.withColumn("_h", hash_order(key, seed, "sample")).orderBy("_h", key).limit(n).drop("_h"))


def _check_sizes(df: DataFrame, group_col: str, n: int, on_short: str) -> None:
    if on_short != "error":
        return
    short = df.groupBy(group_col).count().where(F.col("count") < n).limit(20).collect()
    if short:
        raise ValueError(f"groups smaller than {n} (first 20): {[(r[0], r[1]) for r in short]}")


def balanced_sample(df: DataFrame, group_col: str, n: int, key: str, seed: int = 42,
                    on_short: str = "error") -> DataFrame:
    """Q3 / Q4: exactly ``n`` rows per group in hash order (error when a group
    is short, or ``on_short='take_all'``), then shuffled (``order_key``)."""
    _check_sizes(df, group_col, n, on_short)
    x = df.withColumn("_h", hash_order(key, seed, "balanced"))
    picked = topk_per_group(x, [group_col], [F.col("_h"), F.col(key)], n, "_r").drop("_r", "_h")
    return picked.withColumn("order_key", hash_order(key, seed, "shuffle"))


def bootstrap_per_group(df: DataFrame, group_col: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Q5: ``n`` rows per group; without replacement when the group has at
    least ``n`` rows, else ``n`` draws with replacement.

    Draw ``j`` of a small group picks rank ``1 + hash(group, j) mod size``.
    Only groups smaller than ``n`` are ranked, so a window never holds more
    than ``n`` rows; large groups use the top-n group limit.
    """
    from textlab.session import small
    sizes = small(df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_size")), 64)  # one row per group, counted
    x = df.join(sizes, group_col).withColumn("_h", hash_order(key, seed, "boot"))
    big = x.where(F.col("_size") >= n)
    take = topk_per_group(big, [group_col], [F.col("_h"), F.col(key)], n, "draw").drop("_h", "_size")
    small = x.where(F.col("_size") < n)
    ranked = small.withColumn("_rank", F.row_number().over(
        Window.partitionBy(group_col).orderBy("_h", key)))
    draws = (sizes.where(F.col("_size") < n)
             .select(group_col, "_size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")))
    hj = F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col(group_col).cast("string"), F.lit(":"),
                        F.col("draw").cast("string")))
    draws = draws.withColumn("_rank", (F.conv(F.substring(hj, 1, 8), 16, 10).cast("bigint")
                                       % F.col("_size") + 1).cast("int"))
    with_rep = (draws.join(ranked.drop("_size"), [group_col, "_rank"])
                .drop("_rank", "_h", "_size"))
    return take.withColumn("draw", F.col("draw").cast("int")).unionByName(
        with_rep.withColumn("draw", F.col("draw").cast("int")))


def binary_few_shot(df: DataFrame, k: int, key: str, label_col: str = "label", seed: int = 42) -> DataFrame:
    """Q6: ``min(k, class size)`` per class in hash order, then shuffled."""
    x = df.withColumn("_h", hash_order(key, seed, "fewshot"))
    picked = topk_per_group(x, [label_col], [F.col("_h"), F.col(key)], k, "_r").drop("_r")
    return picked.withColumn("order_key", hash_order(key, seed, "shuffle")).drop("_h")


def random_balanced(df: DataFrame, k: int, key: str, label_col: str = "label", seed: int = 42,
                    balanced: bool = True) -> DataFrame:
    """Q8: ``k // 2`` per class, then fill up to ``k`` from rows not chosen
    (hash order), then shuffle. Not ``balanced``: a plain sample, the first ``k`` rows in hash order, shuffled."""
    x = df.withColumn("_h", hash_order(key, seed, "rb"))
    if not balanced:
        return x.orderBy("_h", key).limit(k).withColumn("order_key", hash_order(key, seed, "shuffle")).drop("_h")
    first = topk_per_group(x, [label_col], [F.col("_h"), F.col(key)], k // 2, "_r").drop("_r")
    rest = exclude_selected(x, first, key)
    n_first = first.agg(F.count(F.lit(1)).alias("_m"))
    top = rest.orderBy("_h", key).limit(k)  # at most k candidates: TakeOrdered
    fill = (top.withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
            .where(F.col("_r") <= F.lit(k) - n_first.scalar())
            .drop("_r"))
    return (first.unionByName(fill).withColumn("order_key", hash_order(key, seed, "shuffle"))
            .drop("_h"))


def shuffle(df: DataFrame, key: str, seed: int = 42, sort: bool = False) -> DataFrame:
    """Q12: seeded whole-table order. Adds ``order_key``; sorts globally only
    when asked (a consumer that needs the order)."""
    x = df.withColumn("order_key", hash_order(key, seed, "shuffle"))
    return x.orderBy("order_key", key) if sort else x
