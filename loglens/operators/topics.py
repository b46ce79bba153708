"""Topics, their partitions and their replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.operators.decode import DECODE_ERROR

# The topics a broker keeps for itself.
INTERNAL_TOPICS = ["__consumer_offsets", "__transaction_state"]
REGISTRATION = "version string, partitions map<string, array<int>>"


def topic_list(log: DataFrame, include_internal: bool = False) -> DataFrame:
    names = log.select("topic")
    if not include_internal:
        names = names.filter(~F.col("topic").isin(INTERNAL_TOPICS))
    return names.distinct()


def parse_registrations(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(good ``topic, version, partitions``, rejects ``topic, reason``) from registration JSON.

    ``partitions`` maps each partition number to the list of its replicas.
    """
    parsed = rows.select("topic", F.from_json(F.col(text), REGISTRATION).alias("r")).select("topic", "r.*")
    good = parsed.filter(F.col("partitions").isNotNull())
    bad = parsed.filter(F.col("partitions").isNull()).select("topic", F.lit(DECODE_ERROR).alias("reason"))
    return good, bad


def partition_infos(registrations: DataFrame) -> DataFrame:
    """(topic, part_id, replicas), one row per partition."""
    return registrations.select("topic", F.explode("partitions").alias("p", "replicas")).select(
        "topic", F.col("p").cast("int").alias("part_id"), "replicas"
    )


def topic_partitions(topics: DataFrame, infos: DataFrame) -> DataFrame:
    """Partitions of the named topics."""
    return topics.select("topic").distinct().join(infos, "topic")


def partition_counts(registrations: DataFrame) -> DataFrame:
    """A registration holds all partitions of its topic, so this is a projection without a shuffle."""
    return registrations.select("topic", F.size("partitions").cast("bigint").alias("n_partitions"))


def replica_counts(infos: DataFrame) -> DataFrame:
    """Replicas of all partitions of a topic together."""
    return infos.groupBy("topic").agg(F.sum(F.size("replicas")).alias("n_replicas"))


def partition_summary(infos: DataFrame) -> DataFrame:
    """Partition and replica counts from partition rows."""
    return infos.groupBy("topic").agg(
        F.count("*").alias("n_partitions"), F.sum(F.size("replicas")).alias("n_replicas")
    )


def replication_factor(infos: DataFrame) -> DataFrame:
    """Replica count of the lowest partition of each topic."""
    return infos.groupBy("topic").agg(
        F.min_by(F.size("replicas"), F.col("part_id")).cast("bigint").alias("replication_factor")
    )
