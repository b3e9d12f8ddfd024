"""Few-shot example selection and retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.hashing import hash_order
from textlab.functions.lexicon import paraphrase_one
from textlab.operators.knn import knn
from textlab.operators.vectors import attach_centroid, group_mean_vector


def near_centroid_sample(df: DataFrame, group_col: str, k: int, oversample: int = 3,
                         id_col: str = "id", vec_col: str = "embedding", seed: int = 42,
                         quota_col: str | None = None) -> DataFrame:
    """Q9: per group, the ``k * oversample`` rows nearest the group centroid
    (Euclidean; ties by id), then ``k`` of those in hash order. A group with
    at most ``k`` rows is kept whole.

    With ``quota_col`` (and ``oversample`` a column name) the per-group
    quota comes from the data (Q7). Both ranks are windows with a group limit,
    so a hot group is trimmed inside each task before the shuffle.
    """
    cent = group_mean_vector(df, group_col, vec_col)
    x = attach_centroid(df, cent, group_col, vec_col)
    if quota_col is None:
        near_lim, pick_lim = F.lit(k * oversample), F.lit(k)
        cap = k * oversample
    else:
        near_lim, pick_lim = F.col(quota_col) * F.col(oversample), F.col(quota_col)
        cap = k
    w1 = Window.partitionBy(group_col).orderBy("dist", id_col)
    near = (x.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= cap)
            .where(F.col("_r1") <= near_lim))
    near = near.withColumn("_h", hash_order(id_col, seed, "near"))
    w2 = Window.partitionBy(group_col).orderBy("_h", id_col)
    return (near.withColumn("_r2", F.row_number().over(w2)).where(F.col("_r2") <= pick_lim)
            .withColumnRenamed("_r1", "near_rank").withColumnRenamed("_r2", "pick_rank").drop("_h"))


def quadrant_quotas(k: int, ratio: int = 3, no_exceptions: bool = False) -> list[tuple[int, int, int, int]]:
    """Q7 quotas ``(rel_cluster, original_label, quota, oversample)``: the
    pattern cells (0,1) and (1,0) get ``k`` (oversample 1 and 5); the exception
    cells (0,0) and (1,1) get ``max(1, k // ratio)`` (or 0), oversample 5."""
    e = 0 if no_exceptions else max(1, k // ratio)
    return [(0, 1, k, 1), (1, 0, k, 5), (0, 0, e, 5), (1, 1, e, 5)]


def quadrant_few_shot(pool: DataFrame, k: int, ratio: int = 3, no_exceptions: bool = False,
                      positive_cluster=0, id_col: str = "id", vec_col: str = "embedding",
                      seed: int = 42) -> DataFrame:
    """Q7: few-shot examples from the four (cluster x original label) cells.

    Clusters are first made relative to the positive cluster (H3), so cell
    (0, 1) always means "positive cluster, positive source". The 4-row quota
    table is broadcast; selection is Q9 with per-cell quotas; the result is
    tagged (T13) and shuffled by hash.
    """
    spark = pool.sparkSession
    pc = positive_cluster if not isinstance(positive_cluster, int) else F.lit(positive_cluster)
    rel = F.when(F.col("cluster") == pc, 0).otherwise(1)
    x = pool.withColumn("rel_cluster", rel.cast("int"))
    x = x.withColumn("quadrant", F.concat_ws("_", F.col("rel_cluster").cast("string"),
                                             F.col("original_label").cast("string")))
    q = spark.createDataFrame([(f"{c}_{l}", quota, over) for c, l, quota, over in
                               quadrant_quotas(k, ratio, no_exceptions)],
                              "quadrant string, quota int, oversample int")
    x = x.join(F.broadcast(q), "quadrant")
    picked = near_centroid_sample(x, "quadrant", 5 * k, id_col=id_col, vec_col=vec_col, seed=seed,
                                  quota_col="quota", oversample="oversample")
    tag = F.when(F.col("rel_cluster") + F.col("original_label") == 1, "pattern").otherwise("exception")
    return (picked.withColumn("kind", tag)
            .withColumn("order_key", hash_order(id_col, seed, "shuffle")))


def semantic_balanced(neighbors: DataFrame, k: int, label_col: str = "label") -> DataFrame:
    """Q10: from each target's top ``2k`` neighbours (rank 1 = most similar),
    up to ``k // 2`` per class in similarity order; if fewer than ``k`` are
    chosen, fill with the best-ranked rows not yet chosen (never repeating a
    row). All windows are per target, over at most ``2k`` rows."""
    top = neighbors.where(F.col("rank") <= 2 * k)
    wc = Window.partitionBy("target_id", label_col).orderBy("rank")
    x = top.withColumn("_rc", F.row_number().over(wc)).withColumn("_chosen", F.col("_rc") <= k // 2)
    wt = Window.partitionBy("target_id")
    x = x.withColumn("_missing", F.lit(k) - F.sum(F.col("_chosen").cast("int")).over(wt))
    wr = Window.partitionBy("target_id", "_chosen").orderBy("rank")
    x = x.withColumn("_rr", F.row_number().over(wr))
    sel = x.where(F.col("_chosen") | (F.col("_rr") <= F.col("_missing")))
    return sel.drop("_rc", "_chosen", "_missing", "_rr")


def retrieve_and_classify(targets: DataFrame, pool: DataFrame, k: int, id_col: str = "id",
                          vec_col: str = "embedding", label_col: str = "label",
                          exclude_self: bool = True, text_col: str | None = None) -> DataFrame:
    """Per target, Q10 examples from the labelled pool (E3), then a
    similarity-weighted vote: prediction 1 when the positive examples' summed
    similarity is larger; confidence = the winning share; a target without
    usable examples gets (0, 0.0, 0.5, 0 examples, status 'no examples').

    With ``text_col`` each target's few-shot prompt (T8: rules, its examples
    in similarity order, the target) is rendered as ``prompt``; ids are chosen first and the texts joined last, and a
    target's example list is bounded by ``k``.
    """
    from textlab.functions import prompts as P
    from textlab.session import stage
    # the all-pairs pass is the expensive part: run it once (targets x 2k rows
    # are written) and let the vote and the prompts both read the result
    nb = stage(knn(targets, pool, 2 * k, id_col, vec_col, [label_col], exclude_self), "neighbours")
    sel = semantic_balanced(nb, k, label_col)
    pos = F.greatest(F.col("sim"), F.lit(0.0))
    agg = sel.groupBy("target_id").agg(
        F.sum(F.when(F.col(label_col) == 1, pos).otherwise(0.0)).alias("s1"),
        F.sum(F.when(F.col(label_col) == 0, pos).otherwise(0.0)).alias("s0"),
        F.count(F.lit(1)).alias("examples_used"))
    tot = F.col("s1") + F.col("s0")
    p1 = F.when(tot > 0, F.col("s1") / tot).otherwise(F.lit(0.5))
    res = agg.select("target_id", (F.col("s1") > F.col("s0")).cast("int").alias("prediction"),
                     F.round(F.greatest(p1, 1 - p1), 6).alias("confidence"),
                     F.round(p1, 6).alias("p_positive"), F.col("examples_used").cast("int"))
    cols = [F.col(id_col).cast("long").alias("target_id")] + ([F.col(text_col).alias("_tt")] if text_col else [])
    t = targets.select(*cols)
    out = t.join(res, "target_id", "left")
    base = [F.col("target_id"), F.coalesce("prediction", F.lit(0)).alias("prediction"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("p_positive", F.lit(0.5)).alias("p_positive"),
            F.coalesce("examples_used", F.lit(0)).alias("examples_used"),
            F.when(F.col("examples_used") > 0, F.lit("ok")).otherwise(F.lit("no examples")).alias("status")]
    if not text_col:
        return out.select(*base)
    ex_text = pool.select(F.col(id_col).cast("long").alias("neighbor_id"),
                          F.col(text_col).alias("_et"))  # whole texts
    lines = sel.select("target_id", "neighbor_id", "rank", label_col).join(ex_text, "neighbor_id")
    line = P.example_line(F.col("_et"), F.col(label_col))
    blk = lines.groupBy("target_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"]), "").alias("_ex"))
    prompt = F.concat(F.lit(P.system_rules() + "\n\n### Examples"), F.coalesce("_ex", F.lit("")),
                      P.target_block("_tt"))
    return (out.join(blk, "target_id", "left")
            .select(*base, prompt.alias("prompt")))


def augment(df: DataFrame, factor: int, text_col: str = "text", id_col: str = "id",
            min_chars: int | None = None) -> DataFrame:
    """The original plus ``factor - 1`` paraphrased variants
    (variant 0 is the original). With ``min_chars`` a variant is kept only if
    longer than that, even when unchanged (T12 uses 10)."""
    v = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("variant"))
    key = F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col("variant").cast("string"))
    v = v.withColumn(text_col, F.when(F.col("variant") == 0, F.col(text_col))
                     .otherwise(paraphrase_one(text_col, key)))
    if min_chars is not None:
        v = v.where((F.col("variant") == 0) | (F.length(text_col) > min_chars))
    return v


def attach_examples_prompt(targets: DataFrame, examples: DataFrame, group_order: Sequence[str],
                           line_col: str = "line", target_text: str = "text") -> DataFrame:
    """T8 helper: per target, its example lines in order, joined into one
    block. ``examples`` holds (target_id, <order cols>, line) with a bounded
    number of rows per target."""
    blk = (examples.groupBy("target_id")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*group_order, line_col))),
                                         lambda s: s[line_col]), "").alias("examples")))
    return targets.join(blk, "target_id", "left")
