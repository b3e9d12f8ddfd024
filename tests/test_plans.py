"""Plan-shape checks: the physical plans we rely on for scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF01

TRAINED = {"sweep_best_trial", "weighted_text_classifier", "domain_shift_auc", "tfidf_features",
           "prototype_clusters", "pca_projection"}
QUERIES = E.queries()


def _plan(spark, name):
    return QUERIES[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINED))
def test_no_pair_joins(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_topk_uses_group_limit_before_shuffle(spark):
    plan = _plan(spark, "sample_errors")
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_dedup_is_partial_aggregate(spark):
    plan = _plan(spark, "compose_post_dedup")
    assert "partial_min_by" in plan


def test_scan_prunes_columns(spark):
    df = QUERIES["load_report"](spark, SF01)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    assert "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["row_index", "running_best"])
def test_numbering_stays_in_the_jvm(spark, name):
    assert "MapInPandas" not in _plan(spark, name)


def test_centroid_join_does_not_move_the_vectors(spark):
    plan = _plan(spark, "attach_centroid")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_totals_read_the_rows_once(spark):
    for name in ("value_shares_lang", "error_breakdown"):
        plan = _plan(spark, name)
        assert plan.split("== Initial Plan ==")[0].count("FileScan") <= 1 or plan.count("FileScan") <= 2


@pytest.mark.parametrize("name,word", [("two_line_reply", "split("), ("json_reply", "parse_json(")])
def test_a_reply_is_parsed_once(spark, name, word):
    """The struct is not copied into each of its fields."""
    from textlab.functions import parse
    df = spark.range(9).selectExpr("cast(id as string) AS reply").select(getattr(parse, name)("reply").alias("p")).select("p.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower().replace("parsejson", "parse_json")
    assert plan.count(word) == 1
