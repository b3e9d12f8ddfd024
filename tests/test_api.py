"""Public helpers not reached by a registered query."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from textlab.plans import adapters as A


def test_quadrant_tag_and_column_choice(spark):
    from textlab.functions.lexicon import cluster_of, original_label_of, quadrant_tag
    df = spark.createDataFrame([(0, 1), (1, 0), (0, 0), (1, 1)], "cluster_id int, label int")
    out = df.select(quadrant_tag(cluster_of(df.columns), original_label_of(df.columns), 0).alias("q")).collect()
    assert [r["q"] for r in out] == ["pattern", "pattern", "exception", "exception"]
    # positive cluster 1: the cells swap meaning
    out1 = df.select(quadrant_tag("cluster_id", "label", 1).alias("q")).collect()
    assert [r["q"] for r in out1] == ["exception", "exception", "pattern", "pattern"]


def test_fast_split_fraction(spark):
    from textlab.operators.sampling import fast_split
    docs = A.table(spark, SF01, "documents").select("doc_id")
    frac = fast_split(docs, "doc_id", 0.2).where("split = 'val'").count() / docs.count()
    assert 0.15 < frac < 0.25


def test_sort_tag_words(spark):
    from textlab.functions.text import word_count
    from textlab.operators.dedup import tag_domain
    from textlab.operators.windows import sort_by_metric
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9)], "model string, f1 double")
    assert [r["model"] for r in sort_by_metric(df).collect()] == ["c", "a", "b"]
    assert tag_domain(df, "x").select("domain").distinct().collect()[0][0] == "x"
    w = spark.createDataFrame([("  a b\tc ",), ("",)], "t string").select(word_count("t").alias("n")).collect()
    assert [r["n"] for r in w] == [3, 0]


def test_silhouette_squared_is_its_own_number(spark):
    from textlab.operators.knn import silhouette, silhouette_squared
    v = A.two_class_vectors(spark, SF01).select("id", "embedding", F.col("original_label").alias("cluster"))
    sq = silhouette_squared(v)
    ex = silhouette(v).first()["silhouette"]
    assert -1.0 <= sq <= 1.0 and sq != pytest.approx(ex, abs=1e-9)


def test_attach_examples_prompt(spark):
    from textlab.operators.fewshot import attach_examples_prompt
    targets = spark.createDataFrame([(1, "t1"), (2, "t2")], "target_id long, text string")
    ex = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "target_id long, rank int, line string")
    got = {r["target_id"]: r["examples"] for r in attach_examples_prompt(targets, ex, ["rank"]).collect()}
    assert got == {1: "ab", 2: "c"}
