"""Plans of the registered queries: nothing that breaks at a large scale."""

import re

import pytest

import __spark_entry__ as entry
from loglens.operators import bag
from loglens.operators.rejects import rejected, tag
from loglens.plans import inputs
from loglens.plans.queries import QUERIES
from tests.conftest import SMALL

WRITES = {"topic_roundtrip"}
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_") and n not in WRITES)
# The few values drawn by each task go to the single partition.
ONE_ROW_PER_TASK = {"bag_sample"}


def plan(df, capsys, mode="simple"):
    capsys.readouterr()
    df.explain(mode=mode)
    return capsys.readouterr().out


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_single_task(spark, capsys, name):
    text = plan(entry.queries()[name](spark, SMALL), capsys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in ONE_ROW_PER_TASK:
        assert "SinglePartition" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "MapInArrow" not in text


def test_columns_are_pruned(spark, capsys):
    text = plan(entry.queries()["word_count"](spark, SMALL), capsys)
    assert "ReadSchema: struct<text:string>" in text
    text = plan(entry.queries()["group_list"](spark, SMALL), capsys)
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_offsets_aggregate_by_hash(spark, capsys):
    text = plan(entry.queries()["latest_commits"](spark, SMALL), capsys)
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


@pytest.mark.parametrize("name", ["bag_counts", "bag_bad_deletes", "orphan_tombstones"])
def test_only_rows_of_heavy_keys_are_ranked(spark, capsys, name):
    """The quantiles are taken after a semi join with the heavy keys, which only a count finds."""
    text = plan(entry.queries()[name](spark, SMALL), capsys)
    for ranked in re.findall(r"(?:ObjectHash|Sort)Aggregate\(keys=.*partial_percentile_approx.*\n(?:.*\n){1,4}", text):
        assert "LeftSemi" in ranked
    assert "percentile_approx" in text and "TakeOrderedAndProject" in text


def test_without_heavy_keys_nothing_is_ranked(spark):
    """What is left of the plan once the list of heavy keys has turned out to be empty."""
    df = entry.queries()["bag_counts"](spark, SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "percentile_approx" not in final and "BroadcastHashJoin" not in final


def test_rejects_start_no_job(spark, events, capsys):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rejects", "rejects")
    try:
        df = rejected(tag(inputs.binary_log(events, damaged=True)))
        assert len(tracker.getJobIdsForGroup("rejects")) == 0
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    text = plan(df, capsys)
    assert "Join" not in text.split("Union")[0] and text.count("Union") == 1


def test_range_reaches_the_scan(spark, capsys):
    text = plan(entry.queries()["topic_range"](spark, SMALL), capsys, "formatted")
    assert re.search(r"PartitionFilters: \[.*topic.* IN \(click,view\)", text)
    pushed = re.search(r"PushedFilters: \[(.*)\]", text)[1]
    assert "EqualTo(partition,0)" in pushed and "GreaterThanOrEqual(offset,5)" in pushed and "LessThan(offset,40)" in pushed


def test_large_sample_has_no_single_task(spark, capsys):
    counts = spark.range(30_000).selectExpr("id as bag_value", "1 + id % 5 as n")
    drawn = bag.bag_sample(counts, k=10_000, few=10, limit=1000)
    text = plan(drawn, capsys).split("Initial Plan")[-1]
    # Only totals go to one task: of slices, and of what a task has seen.
    singles = re.findall(r"Exchange SinglePartition.*\n(.*)", text)
    assert all("Aggregate" in below for below in singles) and "hashpartitioning(0" in text
    assert {r[0] for r in drawn.collect()} == {r[0] for r in bag.bag_sample(counts, k=10_000).collect()}
    with pytest.raises(Exception, match="the bag is empty"):
        bag.bag_sample(counts.filter("n > 100"), k=10_000, few=10).collect()
