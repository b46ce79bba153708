"""Reading and writing topics.

A topic is a DataFrame in the schema of Spark's Kafka source. It comes from a broker, where the connector package is
on the classpath, or from a log table: parquet in the same schema, one folder per topic and batch of writing.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.text import utc_instant
from loglens.operators.hot_keys import SLICE_ROWS, number_rows
from loglens.operators.lag import log_end_offsets

LOG_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
)


def _kafka(reader, topics: list[str] | None, servers: str, options: dict[str, str] | None) -> DataFrame:
    wanted = ("subscribePattern", ".*") if topics is None else ("subscribe", ",".join(topics))
    return (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option(*wanted)
        .option("startingOffsets", "earliest")
        .options(**(options or {}))
        .load()
    )


def _only(log: DataFrame, topics: list[str] | None) -> DataFrame:
    return log if topics is None else log.filter(F.col("topic").isin(topics))


def _one_source(path: str | None, servers: str | None) -> None:
    if (path is None) == (servers is None):
        raise ValueError("give either the path of a log table or the servers of a broker")


def read_topic(
    spark: SparkSession,
    topics: list[str] | None = None,
    path: str | None = None,
    servers: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """All records of the topics (of all topics if none are named) from the earliest on. Every read starts anew;
    there is no order between topics. On a log table only the folders of the named topics are read."""
    _one_source(path, servers)
    if servers:
        return _kafka(spark.read, topics, servers, options)
    log = spark.read.schema(f"{LOG_SCHEMA}, batch string").options(**(options or {})).parquet(path)
    return _only(log.drop("batch"), topics)


#: Per topic and partition the first offset and the one after the last; none for the end of the log.
Ranges = dict[str, dict[int, tuple[int, int | None]]]


def read_range(
    spark: SparkSession,
    ranges: Ranges,
    path: str | None = None,
    servers: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The records in ranges of offsets. On a log table the folders of the named topics are read, and of these only the parts
    whose statistics meet a range; a broker is asked for the ranges alone."""
    _one_source(path, servers)
    if not ranges or not all(ranges.values()):
        raise ValueError("name at least one partition of each topic")
    if servers:
        ends = {t: {str(p): -1 if high is None else high for p, (_, high) in of.items()} for t, of in ranges.items()}
        starts = {t: {str(p): low for p, (low, _) in of.items()} for t, of in ranges.items()}
        return (
            spark.read.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("assign", json.dumps({t: sorted(of) for t, of in ranges.items()}))
            .option("startingOffsets", json.dumps(starts))
            .option("endingOffsets", json.dumps(ends))
            .options(**(options or {}))
            .load()
        )
    log = read_topic(spark, list(ranges), path, options=options)
    offset = F.col("offset")
    wanted = []
    for topic, of in ranges.items():
        for partition, (low, high) in of.items():
            here = (F.col("topic") == topic) & (F.col("partition") == partition) & (offset >= low)
            wanted.append(here if high is None else here & (offset < high))
    return log.filter(reduce(lambda a, b: a | b, wanted))


def stream_topic(
    spark: SparkSession,
    topics: list[str] | None = None,
    path: str | None = None,
    servers: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """The same records as an unbounded stream. ``maxOffsetsPerTrigger`` (broker) or ``maxFilesPerTrigger`` (log
    table) bounds a micro-batch."""
    _one_source(path, servers)
    if servers:
        return _kafka(spark.readStream, topics, servers, options)
    stream = spark.readStream.schema(f"{LOG_SCHEMA}, batch string").options(**(options or {})).parquet(path)
    return _only(stream.drop("batch"), topics)


def text_records(log: DataFrame) -> DataFrame:
    """Keys and values as text: ``topic, part_id, log_offset, msg_key, msg_value, ts``. Null values stay null."""
    return log.select(
        "topic",
        F.col("partition").alias("part_id"),
        F.col("offset").alias("log_offset"),
        F.col("key").cast("string").alias("msg_key"),
        F.col("value").cast("string").alias("msg_value"),
        F.col("timestamp").alias("ts"),
    )


def generate_records(specs: DataFrame, block: int = 10_000) -> DataFrame:
    """Records described by ``topic, msg_key, n, start, message``: the values topic + start, topic + (start + 1), …
    or, where ``message`` is null, exactly one tombstone. The text of ``message`` is not used.

    Gives ``topic, msg_key, seq, msg_value``. A description of many records is cut into blocks that are spread
    over tasks before the records are made.
    """
    last = F.when(F.col("message").isNull(), F.least("n", F.lit(1))).otherwise(F.col("n")) - 1
    blocks = specs.filter(last >= 0).select(
        "topic", "msg_key", "start", "message", last.cast("bigint").alias("last"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block))).alias("b"),
    )
    lo = F.col("b") * block
    spread = blocks.hint("rebalance")
    rows = spread.select(
        "topic", "msg_key", "start", "message",
        F.explode(F.sequence(lo, F.least(F.col("last"), lo + block - 1))).alias("i"),
    )
    seq = F.col("start") + F.col("i")
    value = F.when(F.col("message").isNotNull(), F.concat(F.col("topic"), seq.cast("string")))
    return rows.select("topic", "msg_key", seq.alias("seq"), value.alias("msg_value"))


def place(records: DataFrame, n_partitions: int = 4) -> DataFrame:
    """Adds ``part_id``: all records of a key go to one partition, records without a key are spread by ``seq``."""
    by = F.when(F.col("msg_key").isNotNull(), F.hash("msg_key")).otherwise(F.hash("seq"))
    return records.withColumn("part_id", F.pmod(by, F.lit(n_partitions)))


def number_offsets(
    records: DataFrame,
    seq: str,
    ends: DataFrame | None = None,
    limit: int = SLICE_ROWS,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Adds ``log_offset``: dense per partition, in ``seq`` order, from 0 or from the present log ends on.

    ``seq``, with ``ties`` where it repeats, makes the numbers the same when a lost task is run again.
    """
    numbered = number_rows(records, ["topic", "part_id"], seq, "log_offset", limit, ties)
    if ends is None:
        return numbered
    return numbered.join(ends, ["topic", "part_id"], "left").select(
        *[F.col(c) for c in records.columns],
        (F.col("log_offset") + F.coalesce("log_end", F.lit(0))).alias("log_offset"),
    )


def log_ends(spark: SparkSession, path: str) -> DataFrame | None:
    """Present log ends of a log table; none if there is no table yet."""
    try:
        return log_end_offsets(text_records(read_topic(spark, path=path)))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def change_records(changes: DataFrame, topic: str, key: str, value: str) -> DataFrame:
    """Changed rows of an aggregate as records, one per key: ``topic, msg_key, seq, msg_value``."""
    return changes.select(
        F.lit(topic).alias("topic"),
        F.col(key).cast("string").alias("msg_key"),
        F.xxhash64(key).alias("seq"),
        F.col(value).cast("string").alias("msg_value"),
    )


def write_topic(
    records: DataFrame, path: str | None = None, servers: str | None = None, batch: str | None = None
) -> DataFrame:
    """Appends ``topic, part_id, log_offset, msg_key, msg_value`` and, if there, ``ts`` (zone-less: UTC), and gives what
    was sent: ``topic, part_id, log_offset, msg_key``.

    A log table keeps the given offsets, in a folder for each topic and ``batch``: a batch that is written again under
    the same name replaces itself. Without a name every write is a batch of its own. A broker numbers and stamps the
    records itself, so their offsets are null in the report; they go to the given partitions.
    """
    _one_source(path, servers)
    key, value = F.col("msg_key").cast("binary"), F.col("msg_value").cast("binary")
    if servers:
        partition = [F.col("part_id").cast("int").alias("partition")] if "part_id" in records.columns else []
        sent = records.select("topic", key.alias("key"), value.alias("value"), *partition)
        sent.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
        part_id = F.col("part_id") if partition else F.lit(None)
        return records.select(
            "topic", part_id.cast("int").alias("part_id"), F.lit(None).cast("bigint").alias("log_offset"), "msg_key"
        )
    if "ts" not in records.columns:
        ts = F.current_timestamp()
    elif records.schema["ts"].dataType.typeName() == "timestamp_ntz":
        ts = utc_instant(F.col("ts"))
    else:
        ts = F.col("ts").cast("timestamp")
    name = batch or uuid.uuid4().hex
    rows = records.select(
        key.alias("key"),
        value.alias("value"),
        "topic",
        F.col("part_id").cast("int").alias("partition"),
        F.col("log_offset").alias("offset"),
        ts.alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.lit(name).alias("batch"),
    )
    # Rebalancing gives each topic few files, and cuts a topic that is too large for one task. In order, parts of a file hold
    # narrow ranges of offsets, which reads of a range skip by their statistics.
    ordered = rows.hint("rebalance", "topic").sortWithinPartitions("topic", "batch", "partition", "offset")
    writer = ordered.write.partitionBy("topic", "batch")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    written = records.sparkSession.read.schema(f"{LOG_SCHEMA}, batch string").parquet(path)
    return text_records(written.filter(F.col("batch") == name)).select("topic", "part_id", "log_offset", "msg_key")
