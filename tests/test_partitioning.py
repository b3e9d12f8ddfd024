"""The same answers with many small input partitions (partition independence
across the registry, checked against the DuckDB oracles)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tools.check_oracles import duck, rows_of

NAMES = ["cluster_domain_crosstab", "compose_post_dedup", "stratified_split", "sample_n",
         "bootstrap_per_lang", "random_balanced", "row_index", "running_best", "early_stop",
         "knn_pool", "semantic_balanced", "quadrant_few_shot", "threshold_sweep", "batch_examples"]


@pytest.fixture(scope="module")
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("name", NAMES)
def test_small_partitions_same_answer(spark, small_splits, name):
    sp = E.queries()[name](spark, SF01).toPandas()
    dk = duck(SF01).execute(E.oracle_sql()[name]).df()
    assert rows_of(sp) == rows_of(dk)


SHUFFLE_NAMES = ["stratified_split", "row_index", "early_stop", "bootstrap_per_lang", "compose_post_dedup",
                 "retrieve_and_classify"]


@pytest.mark.parametrize("parts", ["1", "64"])
@pytest.mark.parametrize("name", SHUFFLE_NAMES)
def test_shuffle_partitions_same_answer(spark, name, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sp = E.queries()[name](spark, SF01).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    dk = duck(SF01).execute(E.oracle_sql()[name]).df()
    assert rows_of(sp) == rows_of(dk)


@pytest.mark.parametrize("name", ["load_report_files", "source_tolerant_union", "source_read_messages_dir"])
def test_source_folders_keep_their_partitions(spark, small_splits, tmpdir_fresh, monkeypatch, name):
    """Tables in four parts are written as several files a folder, and each skipped folder is reported once."""
    from pathlib import Path
    from textlab.plans import queries_sources as Q
    for t in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{SF01}/{t}.parquet").repartition(4).write.parquet(f"{tmpdir_fresh}/sf/{t}.parquet")
    monkeypatch.setattr(Q, "_scratch", lambda spark, name: f"{tmpdir_fresh}/out")
    sp = E.queries()[name](spark, f"{tmpdir_fresh}/sf").toPandas()
    assert rows_of(sp) == rows_of(duck(SF01).execute(E.oracle_sql()[name]).df())
    files = [len(list(p.glob("*.parquet"))) for p in Path(tmpdir_fresh, "out").iterdir() if p.is_dir()]
    assert len(files) == 3 and min(files) > 1
