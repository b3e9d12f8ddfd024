"""Registered queries: metrics over the fixture predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions import vector as V
from textlab.functions.hashing import hfrac
from textlab.operators import metrics as M
from textlab.operators.joins import predictions_vs_labels, score_models
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.registry import register

PRED = O.PREDICTIONS_CTE.strip()

COUNTS_SQL = f"""WITH {PRED},
c AS (SELECT model,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 0 OR prediction = 0) AS has0,
  count(*) FILTER (WHERE label = 1 OR prediction = 1) AS has1
  FROM predictions GROUP BY model)"""


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


@register("binary_metrics", COUNTS_SQL + f"""
SELECT model, tp, fp, fn, tn,
  round({_div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy,
  round({_div('tp', 'tp + fp')}, 6) AS precision,
  round({_div('tp', 'tp + fn')}, 6) AS recall,
  round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
  round(CASE WHEN has0 > 0 AND has1 > 0 THEN {_div('tn', 'tn + fp')} ELSE 0.0 END, 6) AS specificity,
  round(CASE WHEN has0 > 0 AND has1 > 0 THEN {_div('tp', 'tp + fn')} ELSE 0.0 END, 6) AS sensitivity,
  round({_div(f"{_div('2 * tp', '2 * tp + fp + fn')} * (tp + fn) + {_div('2 * tn', '2 * tn + fn + fp')} * (tn + fp)",
              'tp + fp + fn + tn')}, 6) AS weighted_f1
FROM c""")
def binary_metrics(spark, d):
    return M.binary_metrics(A.predictions(spark, d), ["model"])


@register("confusion_matrix", f"""WITH {PRED}, cells AS (
  SELECT * FROM (VALUES (0, 0, 'tn'), (0, 1, 'fp'), (1, 0, 'fn'), (1, 1, 'tp')) t(label, prediction, cell)),
mm AS (SELECT DISTINCT model FROM predictions)
SELECT mm.model, cells.label, cells.prediction, cells.cell,
  (SELECT count(*) FROM predictions p WHERE p.model = mm.model AND p.label = cells.label
     AND p.prediction = cells.prediction) AS n
FROM mm, cells""")
def confusion_matrix(spark, d):
    return M.confusion_matrix(A.predictions(spark, d), ["model"])


SWEEP_SQL = f"""WITH {PRED}, t AS (SELECT i, i / 20.0 AS th FROM range(2, 18) r(i)),
s AS (SELECT p.model, t.i,
  count(*) FILTER (WHERE p.prob > t.th AND p.label = 1) AS tp,
  count(*) FILTER (WHERE p.prob > t.th AND p.label = 0) AS fp,
  count(*) FILTER (WHERE NOT (p.prob > t.th) AND p.label = 1) AS fn
  FROM predictions p, t GROUP BY p.model, t.i),
f AS (SELECT model, round(i / 20.0, 2) AS threshold, tp, fp, fn,
             {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM s)"""


@register("threshold_sweep", SWEEP_SQL + "\nSELECT * REPLACE (round(f1, 6) AS f1) FROM f")
def threshold_sweep(spark, d):
    return M.threshold_sweep(A.predictions(spark, d), ["model"])


@register("best_threshold", SWEEP_SQL + """,
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn FROM f)
SELECT model, CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS best_threshold, round(f1, 6) AS best_f1
FROM b WHERE rn = 1""")
def best_threshold(spark, d):
    return M.best_threshold(A.predictions(spark, d), ["model"])


@register("leaderboard", COUNTS_SQL + f""",
m AS (SELECT model, {_div('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
  {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
  {_div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c)
SELECT model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY f1 DESC, model) = 1 AS is_best FROM m""")
def leaderboard(spark, d):
    return M.leaderboard(A.predictions(spark, d))


@register("class_weights", """WITH c AS (SELECT quality AS label, count(*) AS n_c FROM labels GROUP BY quality)
SELECT label, n_c, round(sqrt(sum(n_c) OVER () / (count(*) OVER () * n_c)), 6) AS weight FROM c""")
def class_weights(spark, d):
    lab = A.table(spark, d, "labels").select(F.col("quality").alias("label"))
    return M.class_weights(lab, "label").withColumn("weight", F.round("weight", 6))


@register("fixed_class_weights", """SELECT doc_id, quality AS label,
  CAST(CASE WHEN quality = 1 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS weight FROM labels""")
def fixed_class_weights(spark, d):
    lab = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return lab.withColumn("weight", M.fixed_class_weights("label"))


@register("predictions_vs_labels", f"""WITH {PRED}
SELECT p.model, p.doc_id, p.prediction, l.quality AS label, p.prediction = l.quality AS correct
FROM predictions p JOIN labels l ON p.doc_id = l.doc_id""")
def predictions_vs_labels_q(spark, d):
    pred = A.predictions(spark, d).select("model", "doc_id", "prediction")
    lab = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return predictions_vs_labels(pred, lab, "doc_id")


@register("score_models", f"""WITH {PRED}
SELECT model, doc_id, label, prediction FROM predictions""")
def score_models_q(spark, d):
    ev = A.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))

    def scorer(name, w):
        def fn(df):
            p = (1 - w) * hfrac(F.lit(name), F.col("doc_id")) + w * F.col("label")
            return df.withColumn("prediction", V.threshold_predict(p, 0.5))
        return fn

    long, _skipped = score_models(ev, {m: scorer(m, w) for m, w in A.MODEL_WEIGHTS}, "doc_id")
    return long


@register("error_breakdown", f"""WITH {PRED},
g AS (SELECT model, label, count(*) AS n, count(*) FILTER (WHERE label <> prediction) AS errors
      FROM predictions GROUP BY model, label)
SELECT *, round({_div('errors', 'n')}, 6) AS error_rate,
       round({_div('errors', 'sum(errors) OVER ()')}, 6) AS error_share FROM g""")
def error_breakdown(spark, d):
    return M.error_breakdown(A.predictions(spark, d), ["model", "label"])


@register("logit_functions", f"""WITH {PRED},
x AS (SELECT model, doc_id, prob, [4.0 * (1 - prob), 4.0 * prob] AS logits FROM predictions)
SELECT model, doc_id,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS argmax,
  round(exp(logits[2] - list_max(logits)) /
        (exp(logits[1] - list_max(logits)) + exp(logits[2] - list_max(logits))), 6) AS p_softmax,
  round(1.0 / (1.0 + exp(-(logits[2] - logits[1]))), 6) AS p_sigmoid,
  CAST(prob > 0.6 AS INTEGER) AS pred_06
FROM x""")
def logit_functions(spark, d):
    p = A.predictions(spark, d)
    logits = F.array(F.lit(4.0) * (1 - F.col("prob")), F.lit(4.0) * F.col("prob"))
    x = p.select("model", "doc_id", "prob", logits.alias("logits"))
    return x.select("model", "doc_id", V.argmax("logits").alias("argmax"),
                    F.round(V.softmax("logits")[1], 6).alias("p_softmax"),
                    F.round(V.sigmoid(F.col("logits")[1] - F.col("logits")[0]), 6).alias("p_sigmoid"),
                    V.threshold_predict("prob", 0.6).alias("pred_06"))


def _error_cluster_sql() -> str:
    return O.pool_sql(f"""SELECT model, cluster, label, n, errors,
  round({_div('errors', 'n')}, 6) AS error_rate,
  round({_div('errors', 'sum(errors) OVER (PARTITION BY model)')}, 6) AS error_share FROM g""",
                      O.PREDICTIONS_CTE.strip() + """,
g AS (SELECT p.model, pool.cluster, p.label, count(*) AS n, count(*) FILTER (WHERE p.label <> p.prediction) AS errors
      FROM predictions p JOIN pool ON pool.id = p.doc_id GROUP BY p.model, pool.cluster, p.label)""")


def error_breakdown_cluster(spark, d):
    """Errors per (cluster, true label) for each model, with the error
    rate and the share of the model's errors; clusters come from the H2/H4
    pool (joined by id)."""
    from textlab.plans.audit import labelled_pool
    pool = labelled_pool(spark, d).select(F.col("id").alias("doc_id"), "cluster")
    x = A.predictions(spark, d).join(pool, "doc_id")
    return M.error_breakdown(x, ["model", "cluster", "label"], share_within=["model"])


register("error_breakdown_cluster", _error_cluster_sql())(error_breakdown_cluster)
