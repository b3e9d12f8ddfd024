"""Vector aggregates and joins: group means (G16), centroid distance (E8),
median flag (G17), domain similarity (H8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.vector import as_double_array, euclidean


def group_mean_vector(df: DataFrame, group_col: str, vec_col: str = "embedding",
                      out_col: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group.

    ``posexplode`` + ``groupBy(group, pos)`` keeps everything JVM-side with a
    map-side partial aggregate: the shuffle carries groups x dims rows, not
    the input rows. A hot group is summed in parallel by every task.
    """
    x = df.select(F.col(group_col), F.posexplode(as_double_array(vec_col)).alias("pos", "v"))
    per_dim = x.groupBy(group_col, "pos").agg(F.avg("v").alias("v"))
    return (per_dim.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_pv"))
            .select(group_col, F.transform("_pv", lambda s: s["v"]).alias(out_col)))


def attach_centroid(df: DataFrame, centroids: DataFrame, group_col: str,
                    vec_col: str = "embedding", centroid_col: str = "centroid",
                    out_col: str = "dist") -> DataFrame:
    """Distance of each row to its group's centroid.

    The centroid table has one row per group; its rows are counted, and under the broadcast bound the
    vectors stay where they are. With more groups than that it is a shuffle join (and AQE splits a hot group).
    """
    from textlab.session import small
    dim = centroids.select(F.size(centroid_col)).first()
    return (df.join(small(centroids, 8 * (dim[0] if dim else 0) + 64), group_col, "inner")
            .withColumn(out_col, euclidean(vec_col, centroid_col))
            .drop(centroid_col))


#: Parts that a pass of ``order_statistic`` cuts the remaining range of values into.
PARTS = 1 << 12


def order_statistic(df: DataFrame, col: str, rank: int):
    """The value at 0-based ``rank`` of a numeric column in ascending order (nulls left out, NaN last), exactly.

    Radix selection: a pass counts the values in ``PARTS`` equal parts of the range that still holds the rank, with each
    part's least and greatest value, and goes on inside one part until that holds a single value. A pass is one
    aggregation with partial sums and returns ``PARTS`` rows at most, so no task holds the values.
    """
    c = F.col(col)
    x = df.select(c.alias("v")).where(c.isNotNull())
    # infinities and NaN are parts of their own around the finite range
    low, high = None, None
    while True:
        finite = x.where((F.abs("v") < float("inf")) & ~F.isnan(F.col("v").cast("double")))
        if low is None:
            low, high = finite.agg(F.min("v"), F.max("v")).first()
        width = float(high) - float(low) if low is not None else 0.0
        if width == float("inf"):  # the range itself passes the largest double
            place = F.floor((F.col("v").cast("double") / 2 - float(low) / 2) / (float(high) / 2 - float(low) / 2) * PARTS)
        else:
            place = F.floor((F.col("v").cast("double") - float(low or 0)) / F.lit(width or 1.0) * PARTS)
        v = F.col("v").cast("double")
        part = (F.when(F.isnan(v), F.lit(PARTS + 2)).when(v == float("inf"), F.lit(PARTS + 1)).when(v == float("-inf"), F.lit(-1))
                .otherwise(F.least(place, F.lit(PARTS - 1))).cast("int"))
        counts = x.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["part"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        else:
            raise IndexError("rank beyond the values")
        if r["low"] == r["high"] or not 0 <= r["part"] < PARTS:
            return r["low"]
        low, high = r["low"], r["high"]
        x = x.where(F.col("v").between(low, high))


def exact_median(df: DataFrame, col: str) -> float | None:
    """The median of a numeric column (the mean of the two middle values of an even number), None without values."""
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return None
    low = order_statistic(df, col, (n - 1) // 2)
    if n % 2:
        return float(low)
    # the next value is the same one again, or the least above it
    c = F.col(col)
    upto, above = df.agg(F.count_if(c <= F.lit(low)), F.min(F.when(c > F.lit(low), c))).first()
    return (float(low) + float(low if upto > n // 2 else above)) / 2


def median_flag(df: DataFrame, len_col: str, out_col: str = "long_text",
                exact: bool = True) -> DataFrame:
    """``len > median(len)``. The exact median is found by radix selection (``exact_median``), so no task holds the
    values or their counts; the approximate one is a scalar subquery."""
    if exact:
        med = F.lit(exact_median(df, len_col)).cast("double")
    else:
        med = df.agg(F.percentile_approx(len_col, 0.5, 10000).cast("double").alias("_median")).scalar()
    return df.withColumn(out_col, (F.col(len_col) > med).cast("int"))


def domain_similarity(df: DataFrame, group_col: str = "domain",
                      vec_col: str = "embedding") -> DataFrame:
    """H8: cosine similarity between group centroids (one row per ordered pair).

    Centroids are exploded to (group, dim, value); an equi-join on the
    dimension and a sum per (group_a, group_b) give the dot products. Work is
    groups^2 x dims, never rows x rows.
    """
    x = df.select(F.col(group_col).alias("g"), F.posexplode(as_double_array(vec_col)).alias("pos", "v"))
    c = x.groupBy("g", "pos").agg(F.avg("v").alias("v"))
    nrm = c.groupBy("g").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nrm"))
    a = c.select(F.col("g").alias("group_a"), "pos", F.col("v").alias("va"))
    b = c.select(F.col("g").alias("group_b"), "pos", F.col("v").alias("vb"))
    dots = a.join(b, "pos").groupBy("group_a", "group_b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na = nrm.select(F.col("g").alias("group_a"), F.col("nrm").alias("na"))
    nb = nrm.select(F.col("g").alias("group_b"), F.col("nrm").alias("nb"))
    return (dots.join(na, "group_a").join(nb, "group_b")
            .select("group_a", "group_b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine")))


def domain_nn_distance(df: DataFrame, group_col: str = "domain", id_col: str = "id",
                       vec_col: str = "embedding", max_groups: int = 64) -> DataFrame:
    """H8: for each ordered pair of groups, the mean cosine distance from a row of the first to its nearest row
    (itself aside) of the second. One exact kNN pass (E3) per second group; over ``max_groups`` groups is an error.
    """
    from textlab.operators.knn import knn
    groups = [r[0] for r in df.select(group_col).distinct().orderBy(group_col).limit(max_groups + 1).collect()]
    if len(groups) > max_groups:
        raise ValueError(f"more than {max_groups} groups in {group_col}")
    own = df.select(F.col(id_col).cast("long").alias("target_id"), F.col(group_col).alias("group_a"))
    out = None
    for g in groups:
        near = knn(df, df.where(F.col(group_col).eqNullSafe(F.lit(g))), 1, id_col, vec_col)
        part = (near.join(own, "target_id").groupBy("group_a").agg(F.avg(1 - F.col("sim")).alias("distance"))
                .withColumn("group_b", F.lit(g)))
        out = part if out is None else out.unionByName(part)
    return out.select("group_a", "group_b", F.round("distance", 6).alias("distance"))
