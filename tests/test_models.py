"""Rows-only model jobs: bounds and cross-checks, not exact values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from textlab.plans import adapters as A


def test_weighted_f1_matches_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from textlab.operators.metrics import binary_metrics
    p = A.predictions(spark, SF01).where("model = 'm2'")
    ours = binary_metrics(p).first()["weighted_f1"]
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    theirs = ev.evaluate(p.select(F.col("label").cast("double"), F.col("prediction").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-6)


def test_pca_orthogonal_and_sorted(spark):
    import numpy as np
    from textlab.operators.cluster import pca
    v = A.two_class_vectors(spark, SF01)
    out, ev = pca(v, "embedding", 3)
    assert ev == sorted(ev, reverse=True)
    xs = np.array([r["pca"] for r in out.select("pca").collect()])
    assert abs(xs.mean(axis=0)).max() < 1e-9          # centred
    c = np.corrcoef(xs.T)
    assert abs(c[0, 1]) < 1e-6 and abs(c[0, 2]) < 1e-6  # uncorrelated components


def test_prototype_clusters_reach_the_fixed_point(spark):
    """One more Lloyd step in NumPy changes no label (a run of 20 steps stops too early at this size)."""
    import numpy as np
    from textlab.operators.cluster import fit_pca, prototype_clusters
    v = A.two_class_vectors(spark, "/root/testdata/sf0.1")
    proj = {r["id"]: r["p"] for r in fit_pca(v, "embedding", 50).project(v, "p").select("id", "p").collect()}
    got = prototype_clusters(v, "embedding", 4).select("id", "cluster").collect()
    assert len(got) == len(proj) == v.count()
    x = np.array([proj[r["id"]] for r in got])
    lab = np.array([r["cluster"] for r in got])
    cents = np.array([x[lab == j].mean(axis=0) for j in range(4)])
    assert (((x[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1) == lab).all()


def test_pca_by_sums_matches_numpy(spark):
    """Partitions, null vectors and extra columns change nothing; shares of variance are those of the covariance."""
    import numpy as np
    from textlab.operators.cluster import fit_pca
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)) * [5, 3, 1, 0.2, 0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id int, embedding array<double>").repartition(5)
    m = fit_pca(df, "embedding", 3)
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(axis=0)) @ axes[:, ::-1][:, :3]
    got = {r["id"]: r["pca"] for r in m.project(df).collect()}
    assert got.pop(-1) is None
    assert np.allclose(np.abs([got[i] for i in range(300)]), np.abs(want), atol=1e-9)
    assert np.allclose(m.explained_variance, (values[::-1] / values.sum())[:3])
    assert (m.components[np.abs(m.components).argmax(axis=0), range(3)] > 0).all()
    with pytest.raises(ValueError):
        fit_pca(df.limit(0), "embedding", 2)


def _noisy(spark, n=600, d=4, seed=3):
    import numpy as np
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 1] + [0, 5, 0, -2]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.1 * x[:, 1] + 0.3)))).astype(int)
    w = np.where(y == 1, 2.0, 0.7)
    return spark.createDataFrame([(int(a), float(b), c.tolist()) for a, b, c in zip(y, w, x)], "label int, w double, embedding array<double>")


def test_logistic_matches_spark_ml(spark):
    """All sets fitted together equal Spark ML's separate fits: none, ridge, lasso, mixed; a constant dimension gets 0."""
    from pyspark.ml.classification import LogisticRegression
    from textlab.operators.logistic import fit_logistic
    from textlab.operators.models import vector_features
    df = _noisy(spark).withColumn("embedding", F.array_append("embedding", F.lit(4.0)))
    params = [(0.0, 0.0), (0.05, 0.0), (0.05, 1.0), (0.02, 0.5)]
    x = vector_features(df).withColumn("label", F.col("label").cast("double")).cache()
    for (reg, l1), m in zip(params, fit_logistic(df.repartition(7), params, weight_col="w")):
        ml = LogisticRegression(weightCol="w", regParam=reg, elasticNetParam=l1, maxIter=500, tol=1e-12).fit(x)
        assert m.coefficients == pytest.approx(ml.coefficients.toArray(), abs=2e-5)
        assert m.intercept == pytest.approx(ml.intercept, abs=2e-4)
        assert m.coefficients[-1] == 0
        assert [bool(c) for c in m.coefficients] == [abs(c) > 1e-9 for c in ml.coefficients.toArray()]


def test_logistic_cases(spark):
    """Rows that lack something take no part; separable data without a penalty ends; no rows are an error."""
    from textlab.operators.logistic import fit_logistic
    df = _noisy(spark, 200)
    more = df.unionByName(spark.createDataFrame([(None, 1.0, [1.0] * 4), (1, 1.0, None), (0, None, [9.0] * 4)], df.schema))
    a, b = fit_logistic(df, [(0.1, 0.0)], weight_col="w")[0], fit_logistic(more, [(0.1, 0.0)], weight_col="w")[0]
    assert a.coefficients == pytest.approx(b.coefficients, abs=1e-12)
    assert a.transform(more).where("embedding IS NULL").first()["prob"] is None
    line = spark.createDataFrame([(int(i > 9), [float(i)]) for i in range(20)], "label int, embedding array<double>")
    m, = fit_logistic(line, [(0.0, 0.0)])
    scored = m.transform(line).collect()
    assert all((r["prob"] > 0.5) == (r["label"] == 1) for r in scored) and m.steps < 60
    with pytest.raises(ValueError):
        fit_logistic(df.limit(0), [(0.0, 0.0)])


def test_sweep_steps_serve_all_sets(spark):
    """Jobs follow the steps, not the number of parameter sets."""
    from textlab.operators.models import sweep
    df = _noisy(spark)
    seen = []
    for name, grid in (("one", {"regParam": [0.1]}), ("many", {"regParam": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], "elasticNetParam": [0.0, 0.5]})):
        spark.sparkContext.setJobGroup(f"sweep-{name}", name)
        trials, best, _ = sweep(df, df, grid=grid)
        seen.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep-{name}")))
        assert trials.count() == 3 * (1 if name == "one" else 12) and best.steps > 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[1] <= seen[0] + 12  # a few more steps at most, not twelve fits
    with pytest.raises(ValueError):
        sweep(df, df, grid={"maxIter": [3]})


def test_param_grid_216(spark):
    from textlab.operators.joins import param_grid
    grid = {"a": [1, 2, 3], "b": [10, 20, 30], "c": [0, 1], "d": ["x", "y", "z"], "e": [0.5], "f": [7, 8], "g": [0.1, 0.2]}
    g = param_grid(spark, grid, {"fixed": 0.25})
    rows = g.collect()
    assert len(rows) == 216 and [r["trial"] for r in rows] == list(range(1, 217))
    import itertools
    first = list(itertools.product(*grid.values()))[:3]
    assert [tuple(r[k] for k in grid) for r in rows[:3]] == first


def test_domain_shift_and_sweep_bounds(spark):
    import __spark_entry__ as E
    q = E.queries()
    r = q["domain_shift_auc"](spark, SF01).first()
    assert 0.0 <= r["auc"] <= 1.0 and r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0
    b = q["sweep_best_trial"](spark, SF01).first()
    assert 1 <= b["best_trial"] <= 18
    # better than calling every row positive
    lab = A.two_class_vectors(spark, SF01)
    p = lab.where("original_label = 1").count() / lab.count()
    assert b["best_f1"] > 2 * p / (1 + p)


def test_threshold_on_raw_probability(spark):
    from textlab.operators.metrics import threshold_sweep
    df = spark.createDataFrame([("m", 0.3500004, 1), ("m", 0.35, 0), ("m", None, 1)], "model string, prob double, label int")
    r = threshold_sweep(df).where("threshold = 0.35").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)


def test_score_models_isolates_failures_at_run_time(spark):
    from textlab.operators.joins import score_models
    ev = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")

    def late(df):
        return df.withColumn("prediction", F.raise_error(F.lit("boom")).cast("int"))
    out, skipped = score_models(ev, {"good": lambda df: df.withColumn("prediction", F.lit(1)), "bad": late,
                                     "absent": lambda df: df.select("nothing")}, "doc_id")
    assert {r["model"] for r in out.collect()} == {"good"} and {n for n, _ in skipped} == {"bad", "absent"}


def test_emoji_names():
    from textlab.functions.emoji import demojize_text
    assert demojize_text("a\u2764\ufe0fb \U0001F44D\U0001F3FD") == "a:red_heart:b :thumbs_up_medium_skin_tone:"
    kept = "\u2713 \u0915\u094d\u200d\u0937 x\ufe0f"  # no emoji: a check mark, a joiner inside a word
    assert demojize_text(kept) == kept and demojize_text(None) is None


def test_reply_model_isolates_errors(spark):
    import pandas as pd
    from textlab.operators.scoring import apply_reply_fn
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "fine")], "doc_id long, text string")

    def fn(pdf):
        if (pdf["text"] == "boom").any():
            raise RuntimeError("model failed")
        return pd.Series(["r:" + t for t in pdf["text"]], index=pdf.index)

    got = {r["doc_id"]: (r["reply"], r["status"]) for r in apply_reply_fn(df.repartition(1), fn).collect()}
    assert got[1] == ("r:ok", "ok") and got[2][0] is None and got[2][1].startswith("error")


def test_pca_fit_once_project_many(spark):
    from textlab.operators.cluster import fit_pca, pca
    v = A.two_class_vectors(spark, SF01)
    m = fit_pca(v, "embedding", 2)
    a = {r["id"]: r["pca"] for r in m.project(v.where("label < 5")).collect()}
    b = {r["id"]: r["pca"] for r in pca(v, "embedding", 2)[0].where("label < 5").collect()}
    assert a.keys() == b.keys()
    assert all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k]))


def test_domain_shift_finds_separable_domains(spark):
    """H9: near 1 where the domains differ, near 0.5 where they do not."""
    import numpy as np
    from textlab.operators.models import domain_shift_auc
    rng = np.random.default_rng(9)
    rows = [(int(i % 2), (rng.normal(size=4) + 2 * (i % 2)).tolist(), rng.normal(size=4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "label int, far array<double>, same array<double>")
    for col, low, high in (("far", 0.95, 1.0), ("same", 0.35, 0.65)):
        r = domain_shift_auc(df.limit(200), df.offset(200), "label", col).first()
        assert low <= r["auc"] <= high
