"""Plan-shape guards: no pairwise joins; partial top-k before the shuffle where the design needs it."""

import importlib

import pytest

SF = "/root/testdata/sf0.001"
E = importlib.import_module("__spark_entry__")


def plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["vec_topk", "vec_topk_per_group", "value_match", "graph_search",
                                  "exact_match_gate", "nlq_revenue_by_type_nation", "feedback_votes"])
def test_no_pairwise_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["profile_distinct_values", "chat_nth", "vec_topk"])
def test_window_group_limit(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # do not truncate scan metadata
    try:
        p = plan(spark, "sql_predicates")
        assert "GreaterThan(p_retailprice,950.0)" in p and "PushedFilters" in p
        q = plan(spark, "nlq_top_customers")
        assert "ReadSchema: struct<o_custkey:bigint>" in q      # only the join/group column is read
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
