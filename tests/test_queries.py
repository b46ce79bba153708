"""Every registered query against its SQL form, and against the row counts recorded for the supplied tables."""

import pytest

import __spark_entry__ as entry
from loglens.plans.oracles import ORACLES
from loglens.plans.queries import QUERIES as BASE
from tests.compare import difference, duck
from tests.conftest import MEDIUM, SMALL

QUERIES = sorted(BASE)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_each_query_has_sql():
    assert set(BASE) == set(ORACLES) and set(BASE) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, SMALL) is None


@pytest.mark.parametrize(
    "name, small, medium",
    [
        ("latest_by_key", 67, 676),
        ("index_topic_group", 119, 120),
        ("live_index", 95, 102),
        ("latest_commits", 95, 102),
        ("orphan_tombstones", 54, 420),
        ("lag_report", 92, 98),
        ("bag_bad_deletes", 25, 279),
        ("topic_partition_counts", 25, 25),
        ("word_count", 19_011, 54_084),
    ],
)
def test_expected_rows(spark, name, small, medium):
    assert entry.queries()[name](spark, SMALL).count() == small
    assert entry.queries()[name](spark, MEDIUM).count() == medium


def test_lag_report_nulls(spark):
    report = entry.queries()["lag_report"](spark, MEDIUM).collect()
    assert sum(r["lag"] is None for r in report) == 9
    assert sum(r["consumer_id"] is None for r in report) == 68
    assert not any(r["grp"] == "cg-7" for r in report)


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "grp", "topic", "part_id", "committed", "log_end", "lag", "consumer_id", "host", "client_id"
    ]


@pytest.mark.parametrize("name", ["lag_report", "group_rows", "topic_scan", "orphan_tombstones", "key_value_sets", "index_dump", "rejects"])
def test_same_result_without_small_tables(spark, con, name):
    """As on large tables, where no side of a join is small enough to be sent to all tasks."""
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for limit in limits:
        spark.conf.set(limit, "-1")
    try:
        assert difference(spark, con, name, SMALL) is None
    finally:
        for limit in limits:
            spark.conf.unset(limit)
