"""Classification metrics.

All metrics come from one aggregate of confusion counts per group (usually
per model): a single pass, map-side combined, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, by: Sequence[str] = ("model",), label_col: str = "label",
                     pred_col: str = "prediction") -> DataFrame:
    y, p = F.col(label_col), F.col(pred_col)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) | (p == 0)).alias("_has0"),
        F.count_if((y == 1) | (p == 1)).alias("_has1"),
    )


def binary_metrics(df: DataFrame, by: Sequence[str] = ("model",), label_col: str = "label",
                   pred_col: str = "prediction", digits: int | None = 6) -> DataFrame:
    """G6 + G7 + G8: accuracy, precision, recall, F1 (zero division -> 0),
    specificity and sensitivity (0 unless both classes occur in labels or
    predictions), and support-weighted F1. ``digits=None`` leaves the values raw."""
    c = confusion_counts(df, by, label_col, pred_col)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_0 = _ratio(2 * tn, 2 * tn + fn + fp)
    two = (F.col("_has0") > 0) & (F.col("_has1") > 0)
    r = lambda e: e if digits is None else F.round(e, digits)
    return c.select(
        *by, "tp", "fp", "fn", "tn",
        r(_ratio(tp + tn, n)).alias("accuracy"),
        r(prec).alias("precision"),
        r(rec).alias("recall"),
        r(f1).alias("f1"),
        r(F.when(two, _ratio(tn, tn + fp)).otherwise(F.lit(0.0))).alias("specificity"),
        r(F.when(two, _ratio(tp, tp + fn)).otherwise(F.lit(0.0))).alias("sensitivity"),
        r(_ratio(f1 * (tp + fn) + f1_0 * (tn + fp), n)).alias("weighted_f1"),
    )


def confusion_matrix(df: DataFrame, by: Sequence[str] = ("model",), label_col: str = "label",
                     pred_col: str = "prediction") -> DataFrame:
    """Dense 2 x 2 counts per group, named tn / fp / fn / tp."""
    c = confusion_counts(df, by, label_col, pred_col)
    cells = F.array(*[F.struct(F.lit(lab).alias(label_col), F.lit(pr).alias(pred_col),
                               F.lit(name).alias("cell"), F.col(name).alias("n"))
                      for lab, pr, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*by, F.inline(cells))


# The sweep's 16 cut-offs 0.10, 0.15, ..., 0.85 as exact i/20.
SWEEP_STEPS = list(range(2, 18))


def _sweep(df: DataFrame, by: Sequence[str], label_col: str, prob_col: str) -> DataFrame:
    """Counts and raw F1 at each cut-off ``_i`` / 20.

    Rows are counted per (number of cut-offs strictly below the raw probability, label): at most
    17 x 2 rows per group, exact for any probability. The cut-offs are exploded over those counts.
    """
    p = F.col(prob_col)
    below = sum((F.coalesce(p > i / 20.0, F.lit(False)).cast("int") for i in SWEEP_STEPS), F.lit(0))
    counts = (df.groupBy(*by, below.alias("_b"), F.col(label_col).alias("_y"))
              .agg(F.count(F.lit(1)).alias("_n")))
    x = counts.select("*", F.posexplode(F.array(*[F.lit(i) for i in SWEEP_STEPS])).alias("_k", "_i"))
    pos = F.col("_b") > F.col("_k")
    agg = x.groupBy(*by, "_i").agg(
        F.sum(F.when(pos & (F.col("_y") == 1), F.col("_n")).otherwise(0)).alias("tp"),
        F.sum(F.when(pos & (F.col("_y") == 0), F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~pos & (F.col("_y") == 1), F.col("_n")).otherwise(0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def threshold_sweep(df: DataFrame, by: Sequence[str] = ("model",), label_col: str = "label",
                    prob_col: str = "prob", digits: int = 6) -> DataFrame:
    """G10 (table): F1 at each cut-off, predicting ``prob > t`` (strict, on the raw probability)."""
    return _sweep(df, by, label_col, prob_col).select(
        *by, F.round(F.col("_i") / F.lit(20.0), 2).alias("threshold"), *[F.col(c).cast("bigint") for c in ("tp", "fp", "fn")],
        F.round("f1", digits).alias("f1"))


def best_threshold(df: DataFrame, by: Sequence[str] = ("model",), label_col: str = "label",
                   prob_col: str = "prob", default: float = 0.5, digits: int = 6) -> DataFrame:
    """Best cut-off by raw F1; the lowest cut-off wins ties; ``default``
    when no cut-off gives F1 > 0."""
    s = _sweep(df, by, label_col, prob_col)
    b = s.groupBy(*by).agg(F.max_by(F.struct("_i", "f1"), F.struct(F.col("f1"), -F.col("_i"))).alias("_b"))
    return b.select(*by,
                    F.when(F.col("_b.f1") > 0, F.round(F.col("_b._i") / F.lit(20.0), 2)).otherwise(F.lit(default))
                    .alias("best_threshold"),
                    F.round("_b.f1", digits).alias("best_f1"))


def error_breakdown(df: DataFrame, group_cols: Sequence[str] = ("cluster", "label"),
                    label_col: str = "label", pred_col: str = "prediction",
                    share_within: Sequence[str] = ()) -> DataFrame:
    """Wrong rows per group plus each group's error rate and its share
    of the errors (of all rows, or of each ``share_within`` group, e.g. per
    model; those totals come from the small per-group table)."""
    wrong = F.col(label_col) != F.col(pred_col)
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"))
    g = g.withColumn("error_rate", F.round(_ratio(F.col("errors"), F.col("n")), 6))
    if share_within:
        tot = g.groupBy(*share_within).agg(F.sum("errors").alias("_errors"))
        return (g.join(tot, list(share_within))
                .withColumn("error_share", F.round(_ratio(F.col("errors"), F.col("_errors")), 6))
                .drop("_errors"))
    from pyspark.sql import Window
    total = F.sum("errors").over(Window.partitionBy())  # one row per group: the rows are read once
    return g.withColumn("error_share", F.round(_ratio(F.col("errors"), total), 6))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``sqrt(n / (K * n_c))`` per class (K classes present)."""
    from pyspark.sql import Window
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.withColumn("weight", F.sqrt(F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))))


def attach_class_weights(df: DataFrame, label_col: str = "label", out_col: str = "weight") -> DataFrame:
    """G12 joined back as a weight column (one row per class; broadcast if its counted size allows)."""
    from textlab.session import small
    w = small(class_weights(df, label_col).select(label_col, F.col("weight").alias(out_col)), 64)
    return df.join(w, label_col, "left")


def fixed_class_weights(label_col: str = "label", positive: float = 2.0, negative: float = 1.0):
    """Constant weights per class."""
    return F.when(F.col(label_col) == 1, F.lit(positive)).otherwise(F.lit(negative))


def keyword_priors(df: DataFrame, has_kw_col: str = "has_keyword", label_col: str = "label") -> DataFrame:
    """P(pos | keyword), P(neg | no keyword) and complements, from data."""
    k, y = F.col(has_kw_col), F.col(label_col)
    c = df.agg(F.count_if(k).alias("n_kw"), F.count_if(k & (y == 1)).alias("kw_pos"),
               F.count_if(~k).alias("n_nokw"), F.count_if(~k & (y == 0)).alias("nokw_neg"))
    r = lambda a, b: F.round(_ratio(F.col(a), F.col(b)), 6)
    return c.select("n_kw", "n_nokw",
                    r("kw_pos", "n_kw").alias("p_pos_given_kw"),
                    F.round(F.when(F.col("n_kw") > 0, 1 - _ratio(F.col("kw_pos"), F.col("n_kw")))
                            .otherwise(0.0), 6).alias("p_neg_given_kw"),
                    r("nokw_neg", "n_nokw").alias("p_neg_given_nokw"),
                    F.round(F.when(F.col("n_nokw") > 0, 1 - _ratio(F.col("nokw_neg"), F.col("n_nokw")))
                            .otherwise(0.0), 6).alias("p_pos_given_nokw"))


def leaderboard(df: DataFrame, model_col: str = "model", label_col: str = "label",
                pred_col: str = "prediction") -> DataFrame:
    """G15 + W8: metrics per model, ranked by raw F1 (desc) then model name; rounded last."""
    from pyspark.sql import Window
    m = binary_metrics(df, (model_col,), label_col, pred_col, digits=None)
    w = Window.orderBy(F.desc("f1"), F.asc(model_col))  # one row per model: tiny
    return (m.withColumn("rank", F.row_number().over(w).cast("int"))
            .select(model_col, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "rank",
                    (F.col("rank") == 1).alias("is_best")))


def rank_auc(df: DataFrame, group_cols, label_col: str = "label", score_col: str = "prob") -> DataFrame:
    """H9: exact area under the ROC curve per group: the share of (positive, negative) pairs in which the positive scores
    higher, equal scores counting half (mid-ranks). One row per group: positives, negatives, auc (null without both).

    Rows of one score are counted together, and the negatives below each score come from range slices, so no task
    sorts a group. Sums are exact decimals. Rows with a null score or label take no part; NaN scores rank highest.
    """
    from textlab.operators.windows import group_cumulative_sum
    y = F.col(label_col).cast("double")
    at = (df.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull())
          .groupBy(*group_cols, F.col(score_col).alias("_score"))
          .agg(F.count_if(y == 1).alias("_pos"), F.count_if(y != 1).alias("_neg")))
    run = group_cumulative_sum(at, group_cols, ["_score"], ["_neg"])
    whole = lambda c: c.cast("decimal(19,0)")
    # negatives below, twice, plus those with the same score once
    wins = whole(F.col("_pos")) * whole(2 * (F.col("cum__neg") - F.col("_neg")) + F.col("_neg"))
    g = run.groupBy(*group_cols).agg(F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"), F.sum(wins).alias("_wins"))
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    return g.withColumn("auc", F.try_divide(F.col("_wins").cast("double"), F.nullif(pairs, F.lit(0.0)))).drop("_wins")
