"""Property tests: partition independence, exact quotas, no repeats, dense
indexes, block stitching, monotone k-means inertia."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF01
from textlab.operators import sampling as Q
from textlab.operators.windows import row_index, running_best
from textlab.plans import adapters as A


@pytest.fixture(scope="module")
def labels(spark):
    return A.table(spark, SF01, "labels").select("doc_id", "quality").cache()


def _vals(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("n_parts", [1, 7, 64])
def test_split_partition_independent_and_exact(spark, labels, n_parts):
    base = Q.stratified_split(labels, "quality", "doc_id", 0.2)
    other = Q.stratified_split(labels.repartition(n_parts), "quality", "doc_id", 0.2)
    assert _vals(base, "doc_id", "split") == _vals(other, "doc_id", "split")
    counts = {r[0]: r[1] for r in labels.groupBy("quality").count().collect()}
    quotas = Q.class_quotas(counts, 0.2)
    got = {r[0]: r[1] for r in base.where("split = 'val'").groupBy("quality").count().collect()}
    assert got == {k: v for k, v in quotas.items() if v}
    assert base.count() == labels.count() and base.select("doc_id").distinct().count() == labels.count()


def test_split_small_prefix_many_ties(spark, labels):
    # a 1-char prefix puts ~1/16 of a class in the boundary bucket: still exact
    a = Q.stratified_split(labels, "quality", "doc_id", 0.2, prefix_len=1)
    b = Q.stratified_split(labels, "quality", "doc_id", 0.2, prefix_len=4)
    assert _vals(a, "doc_id", "split") == _vals(b, "doc_id", "split")


@pytest.mark.parametrize("n_parts", [1, 7, 64])
def test_samples_partition_independent(spark, labels, n_parts):
    x = labels.repartition(n_parts)
    s = Q.sample_n(x, 100, "doc_id")
    assert _vals(s, "doc_id") == _vals(Q.sample_n(labels, 100, "doc_id"), "doc_id")
    assert s.select("doc_id").distinct().count() == 100
    b = Q.balanced_sample(x, "quality", 40, "doc_id")
    assert {r[1] for r in b.groupBy("quality").count().collect()} == {40}


def test_balanced_sample_short_group_errors(spark, labels):
    with pytest.raises(ValueError):
        Q.balanced_sample(labels, "quality", 10_000, "doc_id")


def test_bootstrap_sizes(spark):
    docs = A.table(spark, SF01, "documents").select("doc_id", "lang")
    b = Q.bootstrap_per_group(docs, "lang", 300, "doc_id")
    assert {r[1] for r in b.groupBy("lang").count().collect()} == {300}
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    for lang, n in sizes.items():
        if n >= 300:
            assert b.where(F.col("lang") == lang).select("doc_id").distinct().count() == 300


def test_row_index_dense(spark):
    docs = A.table(spark, SF01, "documents").select("doc_id", "source").repartition(5)
    r = row_index(docs, ["source", "doc_id"])
    w = Window.orderBy("source", "doc_id")
    ref = docs.withColumn("ref", F.row_number().over(w) - 1)
    j = r.join(ref, ["doc_id", "source"])
    assert j.where("idx <> ref").count() == 0 and j.count() == docs.count()


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_running_best_blocks_equal_plain_window(spark, block):
    tl = A.trial_log(spark, SF01)
    w = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ref = tl.withColumn("ref", F.max("eval_f1").over(w))
    got = running_best(tl, "trial", "step", "eval_f1", block=block)
    j = got.join(ref, ["trial", "step"])
    assert j.where(~F.col("prev_best").eqNullSafe(F.col("ref"))).count() == 0


def test_kmeans_inertia_never_rises(spark):
    from textlab.operators.cluster import seeded_kmeans
    from textlab.plans.audit import adapters as AD
    v = AD.vectors(spark, SF01).select("id", "embedding", "domain")
    v = v.withColumn("seed", F.when(F.col("domain") == "positive", 0).otherwise(1))
    inert = [seeded_kmeans(v, "embedding", "seed", max_iter=i).inertia() for i in (1, 2, 4, 8)]
    assert all(b <= a + 1e-9 for a, b in zip(inert, inert[1:]))


@pytest.mark.parametrize("sf", [SF01, "/root/testdata/sf0.1"])
def test_kmeans_reaches_the_fixed_point(spark, sf):
    """Plain Lloyd steps in NumPy until no label changes give the same labels."""
    import numpy as np
    from textlab.plans.audit import clustered_vectors
    got = clustered_vectors(spark, sf, "domain").select("id", "embedding", "seed", "cluster").collect()
    x = np.array([r.embedding for r in got], dtype=np.float64)
    lab = np.array([r.seed for r in got])
    cents = np.array([x[lab == j].mean(axis=0) for j in (0, 1)])
    steps = 0
    while True:
        new = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
        steps += 1
        if steps > 1 and (new == lab).all():
            break
        lab = new
        cents = np.array([x[lab == j].mean(axis=0) for j in (0, 1)])
    assert steps > 6 and [r.cluster for r in got] == lab.tolist()


def test_kmeans_matches_mllib(spark):
    """Cross-check H2 against mllib KMeans with the same initial model."""
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import Vectors
    from textlab.operators.cluster import seeded_kmeans
    v = A.two_class_vectors(spark, SF01).withColumn("seed", (1 - F.col("original_label")).cast("int"))
    ours = seeded_kmeans(v, "embedding", "seed")
    init = seeded_kmeans(v, "embedding", "seed", max_iter=0)
    rdd = v.select("embedding").rdd.map(lambda r: Vectors.dense([float(x) for x in r[0]]))
    m = KMeans.train(rdd, 2, maxIterations=300, initialModel=KMeansModel(init.centroids), epsilon=0.0)
    mine = {r["id"]: r["cluster"] for r in ours.assignments.collect()}
    vecs = v.select("id", "embedding").collect()
    agree = sum(1 for r in vecs if m.predict(Vectors.dense([float(x) for x in r[1]])) == mine[r["id"]])
    assert agree / len(vecs) >= 0.99


def test_semantic_balanced_no_duplicates(spark):
    from textlab.operators.fewshot import semantic_balanced
    from textlab.operators.knn import knn
    v = A.two_class_vectors(spark, SF01).select("id", "embedding", F.col("original_label").alias("label"))
    sel = semantic_balanced(knn(v, v, 10, pool_extra=["label"]), 5)
    assert sel.groupBy("target_id", "neighbor_id").count().where("count > 1").count() == 0
    assert sel.groupBy("target_id").count().where("count <> 5").count() == 0


def test_knn_block_split_equals_single_block(spark):
    from textlab.operators.knn import knn
    v = A.two_class_vectors(spark, SF01).select("id", "embedding")
    one = knn(v, v, 5)
    many = knn(v, v, 5, tile_rows=10, cell_rows=20)  # forces many cells and tiles
    assert _vals(one, "target_id", "neighbor_id", "rank") == _vals(many, "target_id", "neighbor_id", "rank")


@pytest.mark.parametrize("tile_rows", [30, 4096])
def test_knn_matches_brute_force(spark, tile_rows):
    """Clustered vectors (so cells are skipped), duplicates, a zero vector and a pool smaller than k."""
    import numpy as np
    from textlab.operators.knn import knn
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 8)) * 5
    x = np.concatenate([centre[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.1, np.zeros((1, 8))])
    x[10] = x[20] = x[30]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    got = {}
    for r in knn(df, df, 7, tile_rows=tile_rows, cell_rows=tile_rows).collect():
        got.setdefault(r["target_id"], []).append((r["rank"], round(r["sim"], 9)))
    for i in range(len(x)):
        want = sorted(np.round(s[i], 9).tolist(), reverse=True)[:7]
        assert [v for _, v in sorted(got[i])] == pytest.approx(want, abs=1e-8)
    assert knn(df, df.limit(3), 7).groupBy("target_id").count().where("count > 3").count() == 0
    assert knn(df, df.limit(0), 7).count() == 0 and knn(df.limit(0), df, 7).count() == 0


def test_silhouette_block_split(spark):
    from textlab.operators.knn import silhouette
    v = A.two_class_vectors(spark, SF01).select("id", "embedding", F.col("original_label").alias("cluster"))
    a = silhouette(v).first()["silhouette"]
    b = silhouette(v, tile_rows=60).first()["silhouette"]
    none = silhouette(v.limit(0)).first()
    assert (none["silhouette"], none["n_points"], none["n_clusters"]) == (None, 0, 0)
    assert a == pytest.approx(b, abs=1e-6) and -1.0 <= a <= 1.0


def test_dedup_first_is_deterministic(spark):
    from textlab.operators.dedup import dedup_first
    p = A.posts(spark, SF01).select("post_id", "retrieved_on")
    a = dedup_first(p, "retrieved_on", "post_id")
    b = dedup_first(p.repartition(13), "retrieved_on", "post_id")
    assert _vals(a, "post_id") == _vals(b, "post_id")
    keep = dedup_first(p, "retrieved_on", "post_id", nulls="keep")
    assert keep.where("retrieved_on IS NULL").count() == p.where("retrieved_on IS NULL").count()


def _fold_reference(rows, patience, threshold):
    """Brute-force early-stop fold (small fixture only)."""
    out = {}
    for t in sorted({r[0] for r in rows}):
        seq = sorted((s, f) for tt, s, f in rows if tt == t and f is not None)
        if not seq:
            continue
        best, bad, stop = float("-inf"), 0, None
        for s, f in seq:
            if f > best + threshold:
                best, bad = f, 0
            else:
                bad += 1
                if bad >= patience:
                    stop = s
                    break
        out[t] = (stop, round(best, 6))
    return out


@pytest.mark.parametrize("block", [2, 3, 7, 4096])
def test_early_stop_blocks_match_fold(spark, block):
    from textlab.operators.trials import early_stop
    tl = A.trial_log(spark, SF01).where("trial < 40")
    rows = [(r["trial"], r["step"], r["eval_f1"]) for r in tl.collect()]
    ref = _fold_reference(rows, 3, 0.01)
    got = {r["trial"]: (r["stop_step"], r["best_at_stop"])
           for r in early_stop(tl, patience=3, threshold=0.01, block=block).collect()}
    assert got == ref


@pytest.mark.parametrize("n_parts", [1, 3])
def test_group_row_number_across_arrow_batches(spark, n_parts):
    from textlab.operators.windows import group_row_number
    ev = A.table(spark, SF01, "events").select("user_id", "ts", "event_id")
    ref = ev.withColumn("ref", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups straddle batches
    try:
        got = group_row_number(ev, ["user_id"], ["ts", "event_id"], "rn", n_parts=n_parts).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r["user_id"], r["event_id"]): r["ref"] for r in ref.collect()}
    assert {(r["user_id"], r["event_id"]): r["rn"] for r in got} == want


def test_group_row_number_null_keys(spark):
    from textlab.operators.windows import group_row_number
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (1, 1), (1, 2)], "g long, o long")
    got = {(r["g"], r["o"]): r["rn"] for r in group_row_number(df, ["g"], ["o"], "rn", n_parts=2).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (None, 3): 3, (1, 1): 1, (1, 2): 2}


def test_knn_visits_a_falling_share_of_the_pairs(spark, monkeypatch):
    """On clustered vectors the share of (target, pool row) pairs that are compared falls as the pool grows, and the
    answer stays that of comparing all rows."""
    import numpy as np
    from textlab.operators import knn as K
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 12))
    x = centres[np.arange(6400) % 30] + rng.normal(size=(6400, 12)) / 40
    stage, shares = K.stage, []
    for n in (400, 1600, 6400):
        seen = {}
        monkeypatch.setattr(K, "stage", lambda df, name: seen.setdefault(name, []).append(out := stage(df, name)) or out)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "id long, embedding array<double>")
        got = K.knn(df.where("id < 200"), df, 4, cell_rows=4).collect()
        sizes = {r["_cell"]: r["count"] for r in seen["knn-tiles"][0].groupBy("_cell").count().collect()}
        visits = [(r["_tid"], r["_cell"]) for v in seen["knn-visits"] for r in v.select("_tid", "_cell").collect()]
        assert len(visits) == len(set(visits))
        shares.append(sum(sizes[c] for _, c in visits) / (200 * n))
        u = x[:n] / np.linalg.norm(x[:n], axis=1, keepdims=True)
        s = u[:200] @ u.T
        s[np.arange(200), np.arange(200)] = -9
        for r in got:
            assert abs(r.sim - np.sort(s[r.target_id])[-r["rank"]]) < 1e-9
        assert len(got) == 800
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3, shares


def test_kmeans_late_steps_leave_sure_rows_alone(spark, monkeypatch):
    """Steps whose borders few rows are near do not read all rows, and give what plain Lloyd gives."""
    import numpy as np
    from textlab.operators import cluster as C
    monkeypatch.setattr(C, "TASK_ROWS", 256)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[-200:] = x[:200]  # repeated rows
    cents = start = x[:3].copy()
    lab, steps = None, 0
    while True:
        steps += 1
        now = ((x[:, None, :] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
        cents = np.array([x[now == j].mean(axis=0) for j in range(3)])
        if lab is not None and (now == lab).all():
            break
        lab = now
    jobs, step = [], C._lloyd_step
    monkeypatch.setattr(C, "_lloyd_step", lambda *a, **k: jobs.append(1) or step(*a, **k))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    res = C.seeded_kmeans(df, init_centroids=start.tolist())
    got = {r["id"]: r["cluster"] for r in res.assignments.select("id", "cluster").collect()}
    assert [got[i] for i in range(len(x))] == now.tolist()
    assert res.n_iter == steps and np.allclose(res.centroids, cents, atol=1e-12)
    assert len(jobs) < steps / 2
