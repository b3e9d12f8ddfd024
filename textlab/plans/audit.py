"""Cluster-label audit: the flagship job.

``documents ⋈ embeddings`` -> domain tag (P10) -> seed centroids per group
(G16) -> seeded 2-means (H2) -> cluster x domain crosstab (G3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.aggregate import crosstab
from textlab.operators.cluster import cluster_labels, seeded_kmeans
from textlab.plans import adapters

DOMAINS = ["positive", "neutral_a", "neutral_b"]


def clustered_vectors(spark: SparkSession, sf_dir: str, seed: str = "domain") -> DataFrame:
    """Vectors with ``cluster`` from a seeded 2-means run to convergence.

    ``seed='domain'``: centroid 0 = mean of the positive domain, 1 = the rest.
    ``seed='original_label'``: centroid 0 = mean of ``original_label = 1``.
    """
    v = adapters.vectors(spark, sf_dir).select("id", "embedding", "domain", "original_label")
    if seed == "domain":
        s = F.when(F.col("domain") == "positive", 0).otherwise(1)
    else:
        s = F.when(F.col("original_label") == 1, 0).otherwise(1)
    v = v.withColumn("seed", s.cast("int"))
    res = seeded_kmeans(v, "embedding", "seed", k=2)
    return res.assignments.withColumn("cluster", F.col("cluster").cast("int"))


def cluster_domain_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = clustered_vectors(spark, sf_dir, "domain")
    return crosstab(a, "cluster", "domain", DOMAINS)


def labelled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few-shot pool: id, embedding, domain, cluster, original_label, label (H4)."""
    a = clustered_vectors(spark, sf_dir, "original_label")
    return cluster_labels(a, "cluster", "original_label").drop("seed", "sqdist")
