import pytest

from loglens.operators import lag
from tests.conftest import rows


@pytest.fixture(scope="module")
def tables(spark):
    assignments = spark.createDataFrame(
        [
            ("g", "t", 0, "c1", "cl1", "/h1"),
            ("g", "t", 1, "c1", "cl1", "/h1"),
            ("g", "t", 1, "c2", "cl2", "/h2"),
            ("g", "unknown", 0, "c2", "cl2", "/h2"),
            ("dead", "t", 0, "c9", "cl9", "/h9"),
        ],
        "grp string, topic string, part_id int, consumer_id string, client_id string, host string",
    )
    commits = spark.createDataFrame(
        [
            (1, "g", "t", 1, 90),
            (2, "g", "t", 1, 120),
            (3, "g", "t", 2, 5),
            (4, "g", "t", 3, 5),
            (5, "g", "t", 3, None),
            (6, "dead", "t", 1, 1),
            (7, "idle", "u", 0, 3),
        ],
        "log_pos bigint, grp string, topic string, part_id int, committed bigint",
    )
    log = spark.createDataFrame(
        [("t", 0, 6), ("t", 0, 9), ("t", 1, 99), ("t", 2, 4), ("u", 0, None)],
        "topic string, part_id int, log_offset bigint",
    )
    groups = spark.createDataFrame(
        [("g", "Stable"), ("dead", "Dead"), ("idle", "Empty")], "grp string, state string"
    )
    offsets = lag.latest_commits(commits)
    return assignments, offsets, lag.log_end_offsets(log), groups


def test_ends(tables):
    assert rows(tables[2]) == [("t", 0, 10), ("t", 1, 100), ("t", 2, 5), ("u", 0, 0)]


def test_report(tables):
    assert rows(lag.lag_report(*tables)) == sorted(
        [
            ("g", "t", 0, None, 10, None, "c1", "/h1", "cl1"),
            ("g", "t", 1, 120, 100, -20, "c1", "/h1", "cl1"),
            ("g", "t", 1, 120, 100, -20, "c2", "/h2", "cl2"),
            ("g", "unknown", 0, None, None, None, "c2", "/h2", "cl2"),
            ("g", "t", 2, 5, 5, 0, None, None, None),
            ("idle", "u", 0, 3, 0, -3, None, None, None),
        ],
        key=repr,
    )


def test_parts(tables):
    assignments, offsets, _, _ = tables
    assert rows(lag.assigned_offsets(assignments, offsets), "grp", "part_id", "committed", "consumer_id") == sorted(
        [("g", 0, None, "c1"), ("g", 1, 120, "c1"), ("g", 1, 120, "c2"), ("g", 0, None, "c2"), ("dead", 0, None, "c9")],
        key=repr,
    )
    assert rows(lag.unassigned_offsets(assignments, offsets)) == [
        ("dead", "t", 1, 1), ("g", "t", 2, 5), ("idle", "u", 0, 3)
    ]


def test_views(tables):
    report, groups = lag.lag_report(*tables), tables[3]
    assert rows(lag.topic_groups(report)) == [("t", "g"), ("u", "idle"), ("unknown", "g")]
    assert rows(lag.topic_group_counts(report)) == [("t", 1), ("u", 1), ("unknown", 1)]
    assert rows(lag.group_snapshot(report, groups)) == [
        ("dead", "Dead", 0, None), ("g", "Stable", 5, -40), ("idle", "Empty", 1, -3)
    ]
    listed = rows(lag.group_rows(report, groups), "grp", "state", "topic", "lag")
    assert len(listed) == 7 and ("dead", "Dead", None, None) in listed and ("idle", "Empty", "u", -3) in listed
    stamp = lag.stamped(report, "2024-05-06 07:08:09").first()["as_of"]
    assert str(stamp) == "2024-05-06 07:08:09"


def test_one_topic_of_very_many_groups(spark, tables):
    """The result has one form at every size."""
    n = 100_001
    report = spark.range(n).selectExpr("'t' as topic", "cast(id as string) as grp").union(spark.sql("select 'u', 'g'"))
    assert rows(lag.topic_group_counts(report)) == [("t", n), ("u", 1)]
    assert lag.topic_groups(report).count() == n + 1
