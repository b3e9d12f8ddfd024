"""Spark ML re-aims of the reference's model work.

GPU fine-tuning is out of scope; the data jobs around it (features, class
weights, splits, parameter sweeps, scoring, metrics) run as Spark ML.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.logistic import fit_logistic, probabilities
from textlab.operators.metrics import attach_class_weights, binary_metrics, rank_auc


def featurize_pipeline(text_col: str = "text", out_col: str = "features",
                       num_features: int = 1 << 18) -> Pipeline:
    """H1: text -> L2-normalised TF-IDF vector (words of letters/digits)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol=out_col, p=2.0),
    ])


def hashed_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num_features: int = 1 << 18) -> DataFrame:
    """H1's vectors as rows: (id, index, weight) of every entry of ``featurize_pipeline``'s L2-normalised vector."""
    docs = df.select(id_col, text_col)
    out = featurize_pipeline(text_col, "_vec", num_features).fit(docs).transform(docs)
    entries = F.unwrap_udt("_vec")  # a sparse vector: its non-zero places and their values
    return out.select(id_col, F.explode(F.arrays_zip(entries["indices"].alias("index"), entries["values"].alias("weight"))).alias("e")).select(
        id_col, "e.index", "e.weight")


def tfidf_terms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """H1 with the terms kept: (id, term, weight), L2-normalised per text, idf = ln((n + 1) / (df + 1)).

    Same words and weights as ``featurize_pipeline`` without its hashing. Texts go by id once, and words are counted,
    weighted and normalised where they are; a term's document frequency is added up in partial aggregates and comes back
    by broadcast if the terms are few enough for it, else by a join on the term (AQE splits a hot one).
    """
    from textlab.session import small
    tokens = F.filter(F.split(F.lower(text_col), r"(?U)\W+"), lambda t: t != "")
    tf = df.select(F.col(id_col).alias("_id"), F.col(text_col)).repartition("_id").select(
        "_id", F.explode(tokens).alias("term")).groupBy("_id", "term").agg(F.count(F.lit(1)).alias("_tf"))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    freq = small(tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")), 64)
    raw = tf.where("_id is not null").join(freq, "term").withColumn("_w", F.col("_tf") * F.ln((n + 1.0) / (F.col("_df") + 1.0)))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_id")))
    return raw.withColumn("_n", norm).select(F.col("_id").alias(id_col), "term",
                                             F.coalesce(F.try_divide("_w", "_n"), F.lit(0.0)).alias("weight"))


def vector_features(df: DataFrame, vec_col: str = "embedding", out_col: str = "features") -> DataFrame:
    """H1 (supplied vectors): array<float> -> ML vector at the ML boundary."""
    return df.withColumn(out_col, array_to_vector(F.col(vec_col).cast("array<double>")))


def train_weighted_classifier(train: DataFrame, label_col: str = "label", text_col: str | None = "text",
                              vec_col: str | None = None, reg: float = 0.01, max_iter: int = 50):
    """Class-weighted logistic regression (G12 weights as ``weightCol``)
    on TF-IDF text features or supplied vectors. Returns a fitted model."""
    w = attach_class_weights(train, label_col, "_w")
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, weightCol="_w",
                            regParam=reg, maxIter=max_iter, probabilityCol="_prob")
    if vec_col:
        return Pipeline(stages=[lr]).fit(vector_features(w, vec_col).withColumn(
            label_col, F.col(label_col).cast("double")))
    stages = featurize_pipeline(text_col).getStages() + [lr]
    return Pipeline(stages=stages).fit(w.withColumn(label_col, F.col(label_col).cast("double")))


def batch_score(model, df: DataFrame, vec_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Score rows; adds ``prob`` (positive class), ``prediction`` (strict
    ``prob > threshold``)."""
    x = vector_features(df, vec_col) if vec_col else df
    out = model.transform(x)
    p = vector_to_array("_prob")[1]
    return (out.withColumn("prob", p).withColumn("prediction", (F.col("prob") > threshold).cast("int"))
            .drop("_prob", "rawPrediction", "features", "_tok", "_tf", "_idf"))


def fit_vectors(train: DataFrame, params: Sequence[tuple[float, float]], label_col: str = "label", vec_col: str = "embedding"):
    """One class-weighted logistic regression (G12 weights) on supplied vectors for each (regParam, elasticNetParam)."""
    return fit_logistic(attach_class_weights(train, label_col, "_w"), params, label_col, vec_col, "_w")


def domain_shift_auc(train: DataFrame, test: DataFrame, label_col: str = "label",
                     vec_col: str = "embedding", reg: float = 0.01) -> DataFrame:
    """H9: can a simple classifier tell two domains apart? One row: exact AUC (``metrics.rank_auc``),
    accuracy, F1 on the held-out split (AUC near 0.5 = no shift)."""
    from textlab.session import stage
    m, = fit_vectors(train, [(reg, 0.0)], label_col, vec_col)
    scored = m.transform(test, vec_col).select(F.lit("all").alias("_all"), label_col, "prob",
                                               (F.col("prob") > 0.5).cast("int").alias("prediction"))
    scored = stage(scored, "shift-scores")
    auc = rank_auc(scored, ["_all"], label_col, "prob")
    met = binary_metrics(scored, ["_all"], label_col, "prediction")
    return met.join(auc, "_all").select(F.round("auc", 6).alias("auc"), "accuracy", "f1", "tp", "fp", "fn", "tn")


def sweep(train: DataFrame, val: DataFrame, label_col: str = "label", vec_col: str = "embedding",
          grid: Mapping[str, Sequence] | None = None, thresholds: Sequence[float] = (0.4, 0.5, 0.6)):
    """A grid over the penalty of a class-weighted logistic regression (``regParam``, ``elasticNetParam``; one left
    out is 0) and the decision threshold, ranked by the F1 on the held-out split; returns (trial table, best model, best
    threshold).

    All parameter sets are fitted together, one job a step (``logistic.fit_logistic``), and all sets and thresholds
    are scored in one pass over ``val``. Ties go to the earlier trial, whose order is the grid's (the threshold varies
    fastest).
    """
    from itertools import product
    grid = grid or {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}
    if set(grid) - {"regParam", "elasticNetParam"}:
        raise ValueError(f"the sweep knows regParam and elasticNetParam, not {sorted(set(grid) - {'regParam', 'elasticNetParam'})}")
    sets = [dict(zip(grid, values)) for values in product(*grid.values())]
    models = fit_vectors(train, [(s.get("regParam", 0.0), s.get("elasticNetParam", 0.0)) for s in sets], label_col, vec_col)
    y = F.col(label_col)
    counts = []
    for m in range(len(sets)):
        for i, t in enumerate(thresholds):
            yes = F.col("_p")[m] > t
            counts += [F.count_if(yes & (y == 1)).alias(f"tp{m}_{i}"), F.count_if(yes & (y == 0)).alias(f"fp{m}_{i}"),
                       F.count_if(~yes & (y == 1)).alias(f"fn{m}_{i}")]
    found = probabilities(val, models, vec_col, "_p").agg(*counts).first()
    rows, best = [], (-1.0, None, None)
    for m, s in enumerate(sets):
        for i, t in enumerate(thresholds):
            tp, wrong = found[f"tp{m}_{i}"], found[f"fp{m}_{i}"] + found[f"fn{m}_{i}"]
            f1 = 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0
            rows.append((len(rows) + 1, *[float(v) for v in s.values()], float(t), f1))
            if f1 > best[0]:
                best = (f1, models[m], t)
    cols = ", ".join(f"{n} double" for n in grid)
    trials = train.sparkSession.createDataFrame(rows, f"trial int, {cols}, threshold double, eval_f1 double")
    return trials, best[1], best[2]
