"""Registered queries: sweep bookkeeping over the trial log."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.operators.trials import best_trial, early_stop, history_summary
from textlab.operators.windows import running_best
from textlab.plans import adapters as A
from textlab.plans import oracles as O
from textlab.plans.registry import register

TL = O.TRIAL_LOG_CTE.strip()


@register("running_best", f"""WITH {TL},
p AS (SELECT *, max(eval_f1) OVER (PARTITION BY trial ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM trial_log)
SELECT trial, step, round(prev, 6) AS prev_best,
       eval_f1 IS NOT NULL AND (prev IS NULL OR eval_f1 >= prev) AS is_best FROM p""")
def running_best_q(spark, d):
    # a small block so the per-block prefix stitching is exercised on test data
    r = running_best(A.trial_log(spark, d), "trial", "step", "eval_f1")
    return r.select("trial", "step", F.round("prev_best", 6).alias("prev_best"), "is_best")


@register("early_stop", f"""WITH RECURSIVE {TL},
nn AS (SELECT DISTINCT trial FROM trial_log WHERE eval_f1 IS NOT NULL),
r(trial, step, best, bad, stop) AS (
  SELECT trial, CAST(0 AS BIGINT), CAST(-1e308 AS DOUBLE), 0, CAST(NULL AS BIGINT) FROM nn
  UNION ALL
  SELECT r.trial, t.step,
    CASE WHEN r.stop IS NOT NULL OR t.eval_f1 IS NULL THEN r.best
         WHEN t.eval_f1 > r.best + 0.01 THEN t.eval_f1 ELSE r.best END,
    CASE WHEN r.stop IS NOT NULL OR t.eval_f1 IS NULL THEN r.bad
         WHEN t.eval_f1 > r.best + 0.01 THEN 0 ELSE r.bad + 1 END,
    CASE WHEN r.stop IS NOT NULL THEN r.stop
         WHEN t.eval_f1 IS NOT NULL AND NOT (t.eval_f1 > r.best + 0.01) AND r.bad + 1 >= 3 THEN t.step END
  FROM r JOIN trial_log t ON t.trial = r.trial AND t.step = r.step + 1),
fin AS (SELECT trial, arg_max(stop, step) AS stop_step, arg_max(best, step) AS best FROM r GROUP BY trial),
mx AS (SELECT trial, max(eval_f1) AS best_f1 FROM trial_log GROUP BY trial)
SELECT fin.trial, fin.stop_step, round(fin.best, 6) AS best_at_stop, round(mx.best_f1, 6) AS best_f1
FROM fin JOIN mx USING (trial)""")
def early_stop_q(spark, d):
    return early_stop(A.trial_log(spark, d), "trial", "step", "eval_f1", patience=3, threshold=0.01)


@register("best_trial", f"""WITH {TL},
t AS (SELECT trial, max(eval_f1) AS f1 FROM trial_log GROUP BY trial)
SELECT trial AS best_trial, round(f1, 6) AS best_f1 FROM t WHERE f1 > 0 ORDER BY f1 DESC, trial LIMIT 1""")
def best_trial_q(spark, d):
    t = A.trial_log(spark, d).groupBy("trial").agg(F.max("eval_f1").alias("eval_f1"))
    return best_trial(t, "trial", "eval_f1")


@register("history_summary", """WITH h AS (
  SELECT user_id AS run, event_id AS step, CAST(event_id % 7 AS DOUBLE) AS epoch,
         CASE WHEN event_type IN ('click', 'view') THEN value END AS loss,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS eval_loss,
         CASE WHEN event_type IN ('purchase', 'signup') THEN value / 1000.0 END AS eval_f1
  FROM events),
k AS (SELECT *, loss IS NOT NULL AND eval_loss IS NULL AS tr, eval_loss IS NOT NULL AS ev FROM h)
SELECT run,
  arg_max(loss, step) FILTER (WHERE tr) AS last_train_loss,
  max(step) FILTER (WHERE tr) AS last_train_step,
  count(*) FILTER (WHERE tr) AS total_steps,
  arg_max(eval_loss, step) FILTER (WHERE ev) AS last_eval_loss,
  arg_max(eval_f1, step) FILTER (WHERE ev) AS last_eval_f1,
  arg_max(epoch, step) FILTER (WHERE ev) AS last_eval_epoch
FROM k GROUP BY run""")
def history_summary_q(spark, d):
    return history_summary(A.history(spark, d), "run", "step")
