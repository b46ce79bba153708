"""Consumer lag and the views built on it.

Inputs: ``commits`` (the commit log, or its live rows), ``assignments`` (grp, topic, part_id, consumer_id, client_id,
host), ``groups`` (grp, state), ``ends`` (topic, part_id, log_end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.operators.index import KEYS
from loglens.operators.latest import latest

DEAD = "Dead"
CONSUMER = ["consumer_id", "host", "client_id"]
REPORT = [*KEYS, "committed", "log_end", "lag", *CONSUMER]


def log_end_offsets(log: DataFrame) -> DataFrame:
    """Next offset of each partition. A known but empty partition may be given as a row with a null offset: 0."""
    end = F.coalesce(F.max("log_offset") + 1, F.lit(0)).cast("bigint")
    return log.groupBy("topic", "part_id").agg(end.alias("log_end"))


def latest_commits(commits: DataFrame) -> DataFrame:
    return latest(commits, KEYS, "committed", "log_pos")


def assigned_offsets(assignments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Every assigned partition with its committed offset, null where none is committed."""
    return assignments.join(offsets, KEYS, "left")


def unassigned_offsets(assignments: DataFrame, offsets: DataFrame) -> DataFrame:
    """Committed offsets of partitions that no member holds."""
    return offsets.join(assignments, KEYS, "left_anti")


def lag(log_end: Column, committed: Column) -> Column:
    """Null if either side is; may be negative."""
    return log_end - committed


def lag_report(assignments: DataFrame, offsets: DataFrame, ends: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per assigned partition and member, and per committed partition without a member.

    One full join covers both; a partition held by two members stays two rows. Groups in state Dead have no rows.
    The sides of each join are already reduced to one row per key; which of them to broadcast is left to the
    optimizer, which sees their sizes at run time, as it does for a partition that very many groups read.
    """
    dead = groups.filter(F.col("state") == DEAD).select("grp")
    held = assignments.join(offsets, KEYS, "full").join(dead, "grp", "left_anti")
    return (
        held.join(ends, ["topic", "part_id"], "left")
        .withColumn("lag", lag(F.col("log_end"), F.col("committed")))
        .select(*REPORT)
    )


def stamped(report: DataFrame, as_of) -> DataFrame:
    """Adds the time of the refresh."""
    return report.withColumn("as_of", F.lit(as_of).cast("timestamp"))


def topic_groups(report: DataFrame) -> DataFrame:
    """(topic, grp): the groups that hold or have committed a partition of each topic."""
    return report.select("topic", "grp").distinct()


def topic_group_counts(report: DataFrame) -> DataFrame:
    """(topic, n_groups) over the whole topic."""
    return topic_groups(report).groupBy("topic").agg(F.count("*").alias("n_groups"))


def group_snapshot(report: DataFrame, groups: DataFrame) -> DataFrame:
    """State, number of rows and total lag of each group. A dead group keeps its state and has no rows."""
    totals = report.groupBy("grp").agg(
        F.count("*").alias("n_partitions"), F.sum("lag").alias("total_lag")
    )
    return groups.join(totals, "grp", "left").select(
        "grp", "state", F.coalesce("n_partitions", F.lit(0)).cast("bigint").alias("n_partitions"), "total_lag"
    )


def group_rows(report: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, state and the columns of the report): each group's rows, or one without a topic for a group that has none."""
    return groups.join(report, "grp", "left").select("grp", "state", *[c for c in REPORT if c != "grp"])
