"""Logs and snapshots made from the supplied tables, in whole. The oracles build the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions import binary as b
from loglens.sources.topics import number_offsets

DAY_MS = 86_400_000
COMMIT_TOPIC = "__consumer_offsets"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As a stream of files. The pattern matches this one name, be it a file or a folder of files; without a pattern
    the source takes folders only."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


# Topic log: records with keys, values, tombstones.


def topic_records(events: DataFrame) -> DataFrame:
    """``log_pos`` is the position in the whole log; works on a table and on a stream."""
    return events.select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("part_id"),
        F.col("event_id").alias("log_pos"),
        F.col("user_id").cast("string").alias("msg_key"),
        F.when(F.col("event_id") % 10 != 0, F.col("props")).alias("msg_value"),
        "ts",
    )


def topic_log(events: DataFrame) -> DataFrame:
    """With offsets dense per partition."""
    return number_offsets(topic_records(events), "log_pos")


def topic_tails(events: DataFrame) -> DataFrame:
    """The last record of each partition. As offsets are dense from 0, its offset is the number of records before it,
    so that log ends need no numbering of the whole log."""
    return topic_records(events).groupBy("topic", "part_id").agg((F.count("*") - 1).alias("log_offset"))


# Commit log, assignments, groups.


def _group(user_id: Column) -> Column:
    return F.concat(F.lit("cg-"), (user_id % 8).cast("string"))


def commit_log(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("log_pos"),
        _group(F.col("user_id")).alias("grp"),
        F.col("event_type").alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("part_id"),
        F.when(k % 5 != 0, F.expr("event_id div 40")).alias("committed"),
        F.col("ts").alias("commit_ts"),
    )


def assignments(events: DataFrame) -> DataFrame:
    """One member for each of the groups 0 to 5; groups 6 and 7 have none, so that their offsets are unassigned."""
    member = (F.col("user_id") % 8).cast("string")
    return (
        events.filter(F.col("user_id") % 8 < 6)
        .select(
            _group(F.col("user_id")).alias("grp"),
            F.col("event_type").alias("topic"),
            (F.col("user_id") % 4).cast("int").alias("part_id"),
            F.concat(F.lit("consumer-"), member).alias("consumer_id"),
            F.concat(F.lit("client-"), member).alias("client_id"),
            F.concat(F.lit("/10.0.0."), member).alias("host"),
        )
        .distinct()
    )


def groups(events: DataFrame) -> DataFrame:
    g = F.col("user_id") % 8
    state = F.when(g == 7, "Dead").when(g == 6, "Empty").otherwise("Stable")
    return events.select(_group(F.col("user_id")).alias("grp"), state.alias("state")).distinct()


# Topic registrations.


def partition_infos(part: DataFrame) -> DataFrame:
    p = F.col("p_size") % 8
    replicas = 1 + (p + F.length("p_brand")) % 3
    return part.select(
        F.col("p_brand").alias("topic"), p.cast("int").alias("part_id"), replicas.cast("int").alias("n_replicas")
    ).distinct()


def registrations(part: DataFrame) -> DataFrame:
    """(topic, registration) with the JSON text; a topic has eight partitions at the most."""
    entry = F.struct(F.col("part_id").cast("string"), F.sequence(F.lit(0), F.col("n_replicas") - 1))
    partitions = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    return partition_infos(part).groupBy("topic").agg(
        F.to_json(F.struct(F.lit("1").alias("version"), partitions.alias("partitions"))).alias("registration")
    )


# Bag, sets, generated records.


def bag_events(events: DataFrame) -> DataFrame:
    delta = F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1)
    return events.select(
        F.col("user_id").alias("bag_value"), F.col("event_id").alias("seq"), delta.alias("delta")
    )


def record_specs(customer: DataFrame) -> DataFrame:
    """1 to 5 records per customer, or one tombstone for those in debt."""
    return customer.select(
        F.col("c_mktsegment").alias("topic"),
        F.col("c_custkey").cast("string").alias("msg_key"),
        (1 + F.col("c_custkey") % 5).alias("n"),
        (F.col("c_custkey") * 100).alias("start"),
        F.when(F.col("c_acctbal") >= 0, "hello").alias("message"),
    )


# Binary log: the commit log and the groups in their wire layout.


def epoch_ms(ts: Column) -> Column:
    """Of a UTC wall time, whatever the session zone is."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * DAY_MS
        + seconds.cast("bigint") * 1000
        + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
    )


def binary_commits(events: DataFrame, damaged: bool = False) -> DataFrame:
    """``log_pos, key, value``. ``damaged`` rewrites some classes of records into bad ones."""
    rows = commit_log(events).withColumn("ms", epoch_ms(F.col("commit_ts")))
    kind = "log_pos % 25" if damaged else "0"
    key_version = f"case {kind} when 3 then 0 when 7 then 7 else 1 end"
    value_version = f"case {kind} when 11 then 0 when 13 then 9 else 1 end"
    expiry = f"case {kind} when 11 then '' else {b.hex_i64(f'ms + {DAY_MS}')} end"
    key = f"concat({b.hex_i16(key_version)}, {b.hex_text('grp')}, {b.hex_text('topic')}, {b.hex_i32('part_id')})"
    value = (
        f"concat({b.hex_i16(value_version)}, {b.hex_i64('committed')}, {b.hex_i16(0)}, {b.hex_i64('ms')}, {expiry})"
    )
    whole = rows.selectExpr("log_pos", f"{key} as k", f"{value} as v")
    if damaged:
        whole = whole.selectExpr(
            "log_pos",
            f"substring(k, 1, length(k) - case {kind} when 19 then 6 else 0 end) as k",
            f"substring(v, 1, case {kind} when 17 then 24 else length(v) end) as v",
        )
    # A null commit makes the whole value null: a tombstone.
    return whole.selectExpr("log_pos", "unhex(k) as key", "unhex(v) as value")


def binary_groups(events: DataFrame, damaged: bool = False) -> DataFrame:
    """One group-metadata record per group, at negative positions."""
    by_topic = assignments(events).groupBy("grp", "consumer_id", "client_id", "host", "topic").agg(
        F.sort_array(F.collect_list("part_id")).alias("parts")
    )
    member = by_topic.groupBy("grp", "consumer_id", "client_id", "host").agg(
        F.sort_array(F.collect_list(F.struct("topic", "parts"))).alias("topics")
    )
    no_user_data = b.hex_i32(-1)
    subscription = f"concat({b.hex_i16(0)}, {b.hex_array('topics', 't', b.hex_text('t.topic'))}, {no_user_data})"
    topic_parts = f"concat({b.hex_text('t.topic')}, {b.hex_array('t.parts', 'p', b.hex_i32('p'))})"
    assignment = f"concat({b.hex_i16(0)}, {b.hex_array('topics', 't', topic_parts)}, {no_user_data})"
    members = member.selectExpr(
        "grp", "consumer_id", "client_id", "host", f"{subscription} as subscription", f"{assignment} as assignment"
    )
    names = ", ".join(b.hex_text(c) for c in ("consumer_id", "client_id", "host"))
    one_member = (
        f"concat({b.hex_i32(1)}, {names}, {b.hex_i32(30_000)}, {b.hex_i32(60_000)}, "
        f"{b.hex_bytes('subscription')}, {b.hex_bytes('assignment')})"
    )
    version = "case g when 0 then 0 when 1 then 5 else 1 end" if damaged else "1"
    protocol = b.hex_text("if(consumer_id is null, null, 'range')")
    value = (
        f"concat({b.hex_i16(version)}, {b.hex_text(repr('consumer'))}, {b.hex_i32('g + 1')}, {protocol}, "
        f"{b.hex_text('consumer_id')}, if(consumer_id is null, {b.hex_i32(0)}, {one_member}))"
    )
    rows = (
        groups(events)
        .join(members, "grp", "left")
        .withColumn("g", F.expr("cast(substring(grp, 4) as bigint)"))
        .selectExpr("g", f"concat({b.hex_i16(2)}, {b.hex_text('grp')}) as k", f"{value} as v")
    )
    if damaged:
        rows = rows.selectExpr("g", "k", "case g when 2 then substring(v, 1, 40) when 3 then null else v end as v")
    return rows.selectExpr("-1 - g as log_pos", "unhex(k) as key", "unhex(v) as value")


def binary_log(events: DataFrame, damaged: bool = False) -> DataFrame:
    return binary_commits(events, damaged).unionByName(binary_groups(events, damaged))


def envelopes(events: DataFrame) -> DataFrame:
    body = "hex(encode(event_type, 'UTF-8'))"
    return events.selectExpr(f"unhex(concat({b.hex_i32('event_id % 3')}, {body})) as data")


