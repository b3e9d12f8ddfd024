"""Work that must not grow faster than the input (findings of round 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def test_emoji_only_sequences_reach_python(spark, monkeypatch):
    """the texts around the emoji stay in the JVM; the result is that of the row function."""
    from textlab.functions import emoji as E
    texts = ["plain", "", None, "\u2764\uFE0F", "a\U0001F44D\U0001F3FDb", "x\U0001F469\u200D\U0001F525y\u200Dz", "\U0001F602" * 3,
             "end \U0001F525", "\u2713 stays \u200D", "\U0001F468\u200D\U0001F468\U0001F3FB\u200D\u2764\uFE0F\u200D tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = df.select("id", "text", E.demojize("text").alias("out"))
    assert all(r["out"] == E.demojize_text(r["text"]) for r in out.collect())
    plan = out._jdf.queryExecution().toString()
    assert "_names" in plan and "regexp_extract_all" in plan


def test_reply_function_sees_bounded_parts(spark, monkeypatch):
    """long texts come in parts of about ``CALL_BYTES``, with the same replies and states."""
    from textlab.operators import scoring as S
    monkeypatch.setattr(S, "CALL_BYTES", 10_000)
    seen = spark.sparkContext.accumulator(0)

    def model(pdf: pd.DataFrame) -> pd.Series:
        seen.add(int(len(pdf) > 30))
        if (pdf["id"] == 7).any():
            raise ValueError("no")
        return pdf["text"].str.len().map(lambda n: None if n is None or n != n else f"{n:.0f}")

    rows = [(i, None if i == 100 else "x" * 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r["id"]: (r["reply"], r["status"]) for r in S.apply_reply_fn(df, model).collect()}
    assert len(got) == 200 and got[100] == (None, "ok") and got[7] == (None, "error: ValueError") and got[9] == ("1000", "ok")
    assert seen.value == 0


def test_tfidf_terms_ships_texts_once(spark):
    """repeated and null ids count as before; no exchange of terms by (id, term)."""
    from textlab.operators.models import tfidf_terms
    rows = [(1, "a b b"), (1, "a c"), (2, "a"), (None, "b d"), (3, None), (4, "")]
    out = tfidf_terms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "hashpartitioning(_id#" in out._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and ", term#" in x for x in out._jdf.queryExecution().executedPlan().toString().splitlines())
    got = {(r["doc_id"], r["term"]): r["weight"] for r in out.collect()}
    idf = {"a": np.log(7 / 3), "b": np.log(7 / 3), "c": np.log(7 / 2)}
    w = {"a": 2 * idf["a"], "b": 2 * idf["b"], "c": idf["c"]}
    norm = np.sqrt(sum(v * v for v in w.values()))
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (2, "a")}
    assert all(abs(got[1, t] - w[t] / norm) < 1e-12 for t in w) and abs(got[2, "a"] - 1) < 1e-12


def test_slices_of_a_resumed_run_have_several_files(spark, tmpdir_fresh):
    """F16: a slice is read by several tasks, as slices follow each other."""
    from textlab.streaming.jobs import resume_generation
    tasks = []

    def generate(df):
        tasks.append(df.rdd.getNumPartitions())
        return df.select("id", F.upper("t").alias("t"))

    todo = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("t"))
    assert resume_generation(todo, tmpdir_fresh + "/out", "id", generate, slice_rows=1024) == 2
    assert min(tasks) > 1
    assert spark.read.parquet(tmpdir_fresh + "/out").where("t = concat('T', id)").count() == 2000


def test_knn_sends_floats_and_orders_few(spark, monkeypatch):
    """vectors travel as floats, and only what reaches the blocks' bound is ordered."""
    from textlab.operators import knn as K
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[450:500] = x[:50]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    kinds, match = [], K._match
    monkeypatch.setattr(K, "_match", lambda visits, *a: kinds.append(visits.schema["_tu"].dataType.elementType.typeName()) or match(visits, *a))
    got = {}
    for r in K.knn(df, df, 3, tile_rows=600, cell_rows=300).collect():
        got[r["target_id"], r["rank"]] = (r["neighbor_id"], r["sim"])
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    top = -np.sort(-s, axis=1)[:, :3]
    assert set(kinds) == {"float"} and len(got) == 2700
    assert all(abs(got[i, k + 1][1] - top[i, k]) < 1e-9 and abs(s[i, got[i, k + 1][0]] - top[i, k]) < 1e-9
               for i in range(900) for k in range(3))


def test_silhouette_compares_a_pair_of_tiles_once(spark):
    """tiles of both orders give the number that all pairs give."""
    from textlab.operators.knn import silhouette
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    c[0] = 9  # alone in its cluster
    df = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(300)], "id long, cluster int, embedding array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    score = []
    for i in range(300):
        own = c == c[i]
        if own.sum() == 1:
            score.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == j].mean() for j in set(c) - {c[i]})
        score.append((b - a) / max(a, b))
    for tile in (40, 1000):
        r = silhouette(df, tile_rows=tile)
        assert str(r._jdf.queryExecution().optimizedPlan().toString()).count("<= ") >= 2 or tile == 1000
        r = r.first()
        assert abs(r["silhouette"] - np.mean(score)) < 1e-6 and r["n_points"] == 300 and r["n_clusters"] == 4
