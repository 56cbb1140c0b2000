"""The plans the queries get: no cross join, pruned scans, partial work before shuffles."""

import re

import pytest
from compare import sf_dir

from storeloom.plans.all_queries import REGISTRY

STREAMED = {n for n in REGISTRY if n.startswith("stream_")} | {"webhook_ingest"}


def plan(spark, name):
    df = REGISTRY[name].run(spark, sf_dir("0.001"))
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMED))
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "pending_recovery")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,P\)", text)
    assert "o_orderpriority" not in text
    text = plan(spark, "failure_match")
    assert re.search(r"PushedFilters: \[[^\]]*StringContains\(props,40\)", text)
    assert "value:double" not in text
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_returnflag:string>", plan(spark, "apply_scans"))


def test_limits_apply_inside_tasks(spark):
    assert plan(spark, "outbox_claim").count("WindowGroupLimit") >= 4
    assert "WindowGroupLimit" in plan(spark, "knn_join")
    assert "TakeOrderedAndProject" in plan(spark, "knn_exact")
    assert "TakeOrderedAndProject" in plan(spark, "prune_history")


@pytest.mark.parametrize(
    "name", ["catalog_classify", "catalog_canonical", "catalog_render", "contact_normalize", "low_stock"]
)
def test_row_by_row_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_a_small_change_set_does_not_shuffle_the_target(spark, tmp_path):
    from storeloom.operators.keyed import insert_ignore, upsert_latest
    from storeloom.plans.fixtures import table

    target = table(spark, sf_dir("0.001"), "lineitem").select("l_orderkey", "l_partkey")
    path = str(tmp_path / "few")
    spark.createDataFrame([(1, 2, 3)], "l_orderkey BIGINT, l_partkey BIGINT, n INT").write.parquet(path)
    few = spark.read.parquet(path)
    for df in (
        upsert_latest(target, few.withColumn("op", few.n.cast("string")), ["l_orderkey"], ["n"]),
        insert_ignore(target, few, ["l_orderkey"], ["n"]),
    ):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_replicas_shuffle_each_side_once(spark):
    assert len(re.findall(r"Exchange hashpartitioning", plan(spark, "dedup_event_id"))) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan(spark, "rate_tumbling"))) == 1
