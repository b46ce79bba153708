"""The registered queries: each runs an operator over whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.functions.text import with_record_text
from loglens.operators import bag, decode, group_metadata, index, lag, latest, sets, topics, words
from loglens.operators.rejects import rejected, tag
from loglens.plans import inputs
from loglens.session import work_path
from loglens.sources import topics as source
from loglens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def events_query(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(inputs.table(spark, sf_dir, "events"))
    return fn


# Sources and sinks


def _written_log(spark, sf_dir) -> tuple[str, DataFrame]:
    """The path of a log table with all records, and the report of what was sent."""
    path = work_path(spark, "topic")
    return path, source.write_topic(inputs.topic_log(inputs.table(spark, sf_dir, "events")), path)


@query
def topic_scan(spark, sf_dir):
    path, _ = _written_log(spark, sf_dir)
    return source.text_records(source.read_topic(spark, path=path)).drop("ts")


@query
def topic_range(spark, sf_dir):
    """A range of offsets of some partitions."""
    path, _ = _written_log(spark, sf_dir)
    wanted = {"click": {0: (5, 40), 2: (0, 25)}, "view": {1: (10, None)}}
    return source.text_records(source.read_range(spark, wanted, path=path)).drop("ts")


@query
def sent_records(spark, sf_dir):
    return _written_log(spark, sf_dir)[1]


@query
def multi_topic_scan(spark, sf_dir):
    path, _ = _written_log(spark, sf_dir)
    wanted = source.text_records(source.read_topic(spark, ["click", "view"], path))
    return wanted.groupBy("topic").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("msg_value").isNull()).alias("n_tombstones")
    )


@events_query
def topic_list(events):
    own = inputs.commit_log(events).select(F.lit(inputs.COMMIT_TOPIC).alias("topic"))
    return topics.topic_list(inputs.topic_records(events).select("topic").unionAll(own))


@events_query
def group_list(events):
    return index.groups(inputs.commit_log(events))


@query
def generate_records(spark, sf_dir):
    specs = inputs.record_specs(inputs.table(spark, sf_dir, "customer"))
    return source.generate_records(specs).select("topic", "msg_key", "msg_value")


@query
def topic_roundtrip(spark, sf_dir):
    """Writes records, then a tombstone for some of their keys, reads them back and keeps the live ones."""
    specs = inputs.record_specs(inputs.table(spark, sf_dir, "customer"))
    first = source.generate_records(specs.withColumn("message", F.lit("hello")))
    deleted = specs.filter(F.col("message").isNull()).withColumn("start", F.col("start") + F.col("n"))
    records = source.place(first.unionByName(source.generate_records(deleted)))
    path = work_path(spark, "topic_roundtrip")
    source.write_topic(source.number_offsets(records, "seq"), path)
    log = source.text_records(source.read_topic(spark, path=path))
    return latest.latest(log, ["topic", "msg_key"], "msg_value", "log_offset")


# Words, text, lookups


@query
def tokens(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return words.word_count(words.tokens(documents, "text", "doc_id"), "doc_id")


@query
def word_count(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("text")
    return words.word_count(words.tokens(documents, "text"))


@query
def record_text(spark, sf_dir):
    path, _ = _written_log(spark, sf_dir)
    log = with_record_text(source.text_records(source.read_topic(spark, path=path)))
    return log.select("topic", "part_id", "log_offset", "text")


@events_query
def null_kinds(events):
    return words.null_kinds(inputs.topic_records(events), "msg_value")


@events_query
def latest_by_key(events):
    return latest.latest(inputs.topic_records(events), ["topic", "msg_key"], "msg_value", "log_pos")


@events_query
def lookup_key(events):
    return latest.lookup(latest_by_key(events), "msg_key", "8").select("topic", "msg_value")


# Binary log


@events_query
def route_counts(events):
    routed = decode.route(inputs.binary_log(events, damaged=True))
    return routed.groupBy("key_version").agg(F.count("*").alias("n"))


@events_query
def decode_commits(events):
    good, _ = decode.split_rejects(decode.decode_commits(inputs.binary_log(events)))
    return good.select("log_pos", "grp", "topic", "part_id", "committed", "commit_ms", "expire_ms")


@events_query
def expired_commits(events):
    return decode.expired_commits(inputs.commit_log(events))


@events_query
def rejects(events):
    return rejected(tag(inputs.binary_log(events, damaged=True)))


def _live_groups(events):
    newest = group_metadata.newest_records(inputs.binary_log(events))
    return group_metadata.live_groups(group_metadata.decode_groups(newest))


@events_query
def group_headers(events):
    return group_metadata.group_headers(_live_groups(events))


def _members(events):
    return group_metadata.group_members(_live_groups(events))


@events_query
def group_members(events):
    return _members(events).drop("topics", "partitions")


@events_query
def member_topics(events):
    return group_metadata.member_topics(_members(events)).select("member_id", "topic")


@events_query
def member_partitions(events):
    rows = group_metadata.member_partitions(_members(events))
    return rows.select(F.col("consumer_id").alias("member_id"), "topic", "part_id")


@events_query
def envelope_versions(events):
    opened = decode.open_envelope(inputs.envelopes(events), "data", expected=1)
    return opened.groupBy("env_version", "version_ok").agg(F.count("*").alias("n"))


# Index


@events_query
def index_topic_group(events):
    return index.ever_seen(inputs.commit_log(events))


@events_query
def index_group_topic(events):
    return index.ever_seen(inputs.commit_log(events)).select("grp", "topic", "part_id")


@events_query
def live_index(events):
    return index.live(inputs.commit_log(events))


@events_query
def index_dump(events):
    dumped = index.dump(index.ever_seen(inputs.commit_log(events)))
    return dumped.filter(F.col("index_kind") == index.TOPIC_TO_GROUP)


@events_query
def orphan_tombstones(events):
    return index.orphan_tombstones(inputs.commit_log(events))


# Lag


@events_query
def log_end_offsets(events):
    return lag.log_end_offsets(inputs.topic_log(events))


@events_query
def latest_commits(events):
    return lag.latest_commits(inputs.commit_log(events))


@events_query
def assigned_offsets(events):
    held = lag.assigned_offsets(inputs.assignments(events), latest_commits(events))
    return held.select("grp", "topic", "part_id", "committed", "consumer_id")


@events_query
def unassigned_offsets(events):
    return lag.unassigned_offsets(inputs.assignments(events), latest_commits(events))


@events_query
def lag_report(events):
    ends = lag.log_end_offsets(inputs.topic_tails(events))
    return lag.lag_report(inputs.assignments(events), latest_commits(events), ends, inputs.groups(events))


@events_query
def topic_groups(events):
    return lag.topic_groups(lag_report(events))


@events_query
def topic_group_counts(events):
    return lag.topic_group_counts(lag_report(events))


@events_query
def group_snapshot(events):
    return lag.group_snapshot(lag_report(events), inputs.groups(events))


@events_query
def group_rows(events):
    rows = lag.group_rows(lag_report(events), inputs.groups(events))
    return rows.select("grp", "state", "topic", "part_id", "lag", "consumer_id")


# Topics


def _infos(spark, sf_dir):
    rows = inputs.registrations(inputs.table(spark, sf_dir, "part"))
    return topics.partition_infos(topics.parse_registrations(rows, "registration")[0])


@query
def topic_partitions(spark, sf_dir):
    names = topics.topic_list(inputs.registrations(inputs.table(spark, sf_dir, "part")))
    return topics.topic_partitions(names, _infos(spark, sf_dir)).select(
        "topic", "part_id", F.size("replicas").alias("n_replicas")
    )


@query
def topic_partition_counts(spark, sf_dir):
    rows = inputs.registrations(inputs.table(spark, sf_dir, "part"))
    return topics.partition_counts(topics.parse_registrations(rows, "registration")[0])


@query
def registration_rejects(spark, sf_dir):
    """Registrations whose text was cut short for some of the topics."""
    rows = inputs.registrations(inputs.table(spark, sf_dir, "part"))
    whole = F.length("topic") % 2 == 0
    whole = whole & ~F.col("topic").endswith("3")
    damaged = rows.withColumn("registration", F.when(whole, F.col("registration")).otherwise(F.substring("registration", 1, 20)))
    return topics.parse_registrations(damaged, "registration")[1]


@query
def topic_replica_counts(spark, sf_dir):
    return topics.replica_counts(_infos(spark, sf_dir))


@query
def replication_factor(spark, sf_dir):
    return topics.replication_factor(_infos(spark, sf_dir))


# Sets and bag


@query
def key_value_sets(spark, sf_dir):
    """The number of values of each key, over the pairs."""
    pairs = sets.key_values(inputs.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("n_values"))


@query
def key_value_pairs(spark, sf_dir):
    return sets.key_values(inputs.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@events_query
def bag_counts(events):
    return bag.bag_counts(inputs.bag_events(events))


@events_query
def bag_bad_deletes(events):
    return bag.bag_bad_deletes(inputs.bag_events(events))


@events_query
def bag_sample(events):
    return bag.bag_sample(bag_counts(events), k=20, seed=0)


# Streams: each works off what the source holds and gives the table the stream keeps


def _run(spark, name, job: Callable[[str], jobs.Job]) -> DataFrame:
    path = work_path(spark, name)
    return job(f"{path}/tables").run(f"{path}/checkpoint")


@query
def stream_topic_scan(spark, sf_dir):
    records = inputs.topic_log(inputs.table(spark, sf_dir, "events"))
    path = work_path(spark, "topic")
    source.write_topic(records, path)
    log = source.text_records(source.stream_topic(spark, path=path)).drop("ts")
    return _run(spark, "stream_topic_scan", lambda p: jobs.append_job(log, p))


@query
def stream_word_count(spark, sf_dir):
    documents = inputs.stream_table(spark, sf_dir, "documents")
    return _run(spark, "stream_word_count", lambda p: jobs.word_count_job(documents, "text", p))


@query
def stream_word_count_topic(spark, sf_dir):
    """The running counts as records of a topic, whose newest record per word is read back."""
    documents = inputs.stream_table(spark, sf_dir, "documents")
    path = work_path(spark, "counts_topic")
    job = jobs.word_count_job(documents, "text", f"{path}/tables")
    jobs.publish(job, "counts", "word", "n", path=f"{path}/log").run(f"{path}/checkpoint")
    log = source.text_records(source.read_topic(spark, ["counts"], f"{path}/log"))
    newest = latest.latest(log, ["topic", "msg_key"], "msg_value", "log_offset")
    return newest.select(F.col("msg_key").alias("word"), F.col("msg_value").cast("bigint").alias("n"))


@query
def stream_latest_by_key(spark, sf_dir):
    log = inputs.topic_records(inputs.stream_table(spark, sf_dir, "events"))
    return _run(
        spark, "stream_latest_by_key",
        lambda p: jobs.latest_job(log, ["topic", "msg_key"], "msg_value", "log_pos", p),
    )


@query
def stream_lookup_key(spark, sf_dir):
    """One key from the table that the stream keeps in slots: the files of one slot are read."""
    log = inputs.topic_records(inputs.stream_table(spark, sf_dir, "events"))
    path = work_path(spark, "stream_lookup_key")
    job = jobs.latest_job(log, ["topic", "msg_key"], "msg_value", "log_pos", f"{path}/tables", slot_by="msg_key")
    job.run(f"{path}/checkpoint")
    return job.table.lookup(spark, "8").filter(F.col("msg_value").isNotNull()).select("topic", "msg_value")


@query
def stream_key_value_sets(spark, sf_dir):
    orders = inputs.stream_table(spark, sf_dir, "orders")
    return _run(
        spark, "stream_key_value_sets", lambda p: jobs.key_values_job(orders, "o_custkey", "o_orderpriority", p)
    )


@query
def stream_index(spark, sf_dir):
    log = inputs.commit_log(inputs.stream_table(spark, sf_dir, "events"))
    return _run(spark, "stream_index", lambda p: jobs.index_job(log, p))


@query
def stream_index_dump(spark, sf_dir):
    """Both directions, from the table that the stream keeps."""
    return index.dump(stream_index(spark, sf_dir))


@query
def stream_live_index(spark, sf_dir):
    log = inputs.commit_log(inputs.stream_table(spark, sf_dir, "events"))
    return _run(spark, "stream_live_index", lambda p: jobs.index_job(log, p, expire=True))


@query
def stream_orphan_tombstones(spark, sf_dir):
    log = inputs.commit_log(inputs.stream_table(spark, sf_dir, "events"))
    return _run(spark, "stream_orphan_tombstones", lambda p: jobs.orphan_job(log, p))


def _lag_stream(spark, sf_dir) -> jobs.LagTables:
    path, _ = _written_log(spark, sf_dir)
    log = source.text_records(source.stream_topic(spark, path=path))
    commits = inputs.commit_log(inputs.stream_table(spark, sf_dir, "events"))
    work = work_path(spark, "stream_lag_report")
    job, tables = jobs.lag_job(
        log, commits,
        lambda s: inputs.assignments(inputs.table(s, sf_dir, "events")),
        lambda s: inputs.groups(inputs.table(s, sf_dir, "events")),
        f"{work}/tables",
    )
    job.run(f"{work}/checkpoint")
    return tables


@query
def stream_lag_report(spark, sf_dir):
    return _lag_stream(spark, sf_dir).report.read(spark).drop("as_of")


@query
def stream_topic_groups(spark, sf_dir):
    return _lag_stream(spark, sf_dir).topic_groups.read(spark)


@query
def stream_group_snapshot(spark, sf_dir):
    return _lag_stream(spark, sf_dir).groups.read(spark)
