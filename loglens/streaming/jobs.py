"""The stream forms of the operators.

A job pairs a streaming DataFrame with the table that holds its result. State is not expired unless a job is given a time to
live (``expiry``), as deletes arrive as records; tombstones stay in the state so that an older record that comes late cannot bring its key back.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loglens.operators.decode import ORPHAN
from loglens.operators.hot_keys import SLICE_ROWS, join_skewed, previous_value
from loglens.operators.index import KEYS
from loglens.operators.lag import CONSUMER, REPORT, group_snapshot, lag_report, log_end_offsets, stamped, topic_groups
from loglens.operators.latest import latest, newest
from loglens.operators.sets import whole_pairs
from loglens.operators.words import tokens, word_count
from loglens.sources.topics import change_records, number_offsets, place, write_topic
from loglens.streaming.expiry import expiring_latest, newest_of_task
from loglens.streaming.tables import GONE, ChangeTable

Table = Callable[[SparkSession], DataFrame]
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@dataclass
class Job:
    output: DataFrame
    mode: str
    write: Callable[[DataFrame, int], None]
    read: Table
    table: ChangeTable | None = None
    timed: bool = False

    def start(self, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the job; a second start with the same checkpoint goes on where the first one ended.

        State lives where the session says. The default provider keeps it on the heap of the executors; sessions with
        large state should name the RocksDB provider, as ``local_session`` does."""
        return (
            self.output.writeStream.outputMode(self.mode)
            .foreachBatch(self.write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def run(self, checkpoint: str) -> DataFrame:
        """Works off what is there now and gives the resulting table. Keys whose time ran out leave with the records of the next
        run; batches without records, which timers would ask for without end, are left out."""
        conf = self.output.sparkSession.conf
        before = conf.get(IDLE_BATCHES, None)
        if self.timed:
            conf.set(IDLE_BATCHES, "false")  # the query keeps the settings of its start
        try:
            query = self.start(checkpoint, availableNow=True)
        finally:
            if self.timed:
                conf.set(IDLE_BATCHES, before) if before is not None else conf.unset(IDLE_BATCHES)
        query.awaitTermination()
        return self.read(self.output.sparkSession)


def append_job(stream: DataFrame, path: str, keep_seconds: float | None = None) -> Job:
    """Keeps the records of a stream as they are."""
    table = ChangeTable(f"{path}/rows", keep_seconds=keep_seconds)
    columns = stream.columns
    return Job(stream, "append", table.write, lambda spark: table.read(spark).select(*columns), table)


def word_count_job(stream: DataFrame, text: str, path: str, keep_seconds: float | None = None) -> Job:
    """Running word count; each batch writes the counts that changed."""
    table = newest_table(f"{path}/counts", ["word"], "n", "batch_id", keep_seconds)
    counts = word_count(tokens(stream, text))
    return Job(counts, "update", table.write, lambda spark: table.read(spark).select("word", "n"), table)


def _last_offsets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("topic", "part_id").agg(F.max("log_offset").alias("log_offset"))


def publish(job: Job, topic: str, key: str, value: str, path: str | None = None, servers: str | None = None) -> Job:
    """Also sends what each batch of ``job`` changed to a topic. A batch that is run again replaces its records in a log
    table, with the same offsets; a broker gets them again."""
    spark = job.output.sparkSession
    ends = ChangeTable(f"{path}-ends", _last_offsets)

    def write(batch: DataFrame, batch_id: int) -> None:
        job.write(batch, batch_id)
        # Read back in the outer session: in that of the stream, plans do not adapt at run time.
        records = change_records(job.table.changes(spark, batch_id), topic, key, value)
        if servers:
            write_topic(records, servers=servers)
            return
        present = log_end_offsets(ends.read(spark, batch_id - 1)) if batch_id else None
        numbered = number_offsets(place(records), "seq", present, ties=("msg_key",)).persist()
        try:
            write_topic(numbered, path, batch=str(batch_id))
            ends.write(_last_offsets(numbered), batch_id)
        finally:
            numbered.unpersist()

    return Job(job.output, job.mode, write, job.read, job.table)


def newest_table(
    path: str, keys: list[str], value: str, order: str, keep_seconds: float | None = None, slot_by: str | None = None
) -> ChangeTable:
    return ChangeTable(path, lambda rows: newest(rows, keys, value, order), keep_seconds=keep_seconds, slot_by=slot_by)


def latest_job(
    stream: DataFrame, keys: list[str], value: str, order: str, path: str, keep_seconds: float | None = None,
    slot_by: str | None = None, ttl_seconds: float | None = None,
) -> Job:
    """Last value per key with deletes. The record with the highest ``order`` wins, whatever it arrives after. With
    ``slot_by``, one of the keys, the table takes point lookups by it. With ``ttl_seconds`` a key without records for that time
    leaves the state and the table, and an older record that comes after that brings it back."""
    if ttl_seconds is not None:
        kept = keyed_table(f"{path}/latest", keys, keep_seconds, slot_by)
        changes = expiring_latest(stream, keys, value, order, ttl_seconds)
        return Job(changes, "update", kept.write, lambda spark: kept.read(spark).select(*keys, value), kept, timed=True)
    table = newest_table(f"{path}/latest", keys, value, order, keep_seconds, slot_by)

    def live(spark: SparkSession) -> DataFrame:
        return table.read(spark).filter(F.col(value).isNotNull()).select(*keys, value)

    return Job(newest(stream, keys, value, order), "update", table.write, live, table)


def distinct_job(stream: DataFrame, path: str, keep_seconds: float | None = None) -> Job:
    """Distinct rows of a stream, each written once, by the batch that first has it.

    The rows are the keys of a streaming aggregate, so copies are reduced in each task before the shuffle, and a batch costs
    by the keys it touches. A key whose first and last batch are the same one is new; a batch that is run again has the
    same time as before.
    """
    columns = stream.columns
    table = ChangeTable(f"{path}/distinct", keep_seconds=keep_seconds)
    timed = stream.withColumn("_at", F.current_timestamp())
    seen = timed.groupBy(*columns).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.filter(F.col("_first") == F.col("_last")).select(*columns), batch_id)

    return Job(seen, "update", write, lambda spark: table.read(spark).select(*columns), table)


def key_values_job(stream: DataFrame, key: str, value: str, path: str, keep_seconds: float | None = None) -> Job:
    """Set per key, in long form: the table holds single pairs, never the whole set of a key."""
    return distinct_job(whole_pairs(stream, key, value), path, keep_seconds)


def index_job(
    commits: DataFrame, path: str, expire: bool = False, keep_seconds: float | None = None, ttl_seconds: float | None = None
) -> Job:
    """Topic, group and partition of every commit ever seen, or with ``expire`` of the commits that still stand."""
    if not expire:
        seen = commits.filter(F.col("committed").isNotNull())
        return distinct_job(seen.select("topic", "grp", "part_id"), path, keep_seconds)
    job = latest_job(commits, KEYS, "committed", "log_pos", path, keep_seconds, ttl_seconds=ttl_seconds)
    standing = job.read
    job.read = lambda spark: standing(spark).select("topic", "grp", "part_id")
    return job


LATE = "late_record"


def _state_before(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gives the last position of a key and whether it was live before this batch, and takes note of those after it."""
    before = state.get if state.exists else None
    last, live = before or (None, False)
    for rows in parts:
        newest = rows.loc[rows["last"].idxmax()]
        if last is None or newest["last"] > last:
            last, live = int(newest["last"]), bool(newest["live"])
    state.update((last, live))
    if before is not None:
        names = dict(zip(KEYS, key, strict=True))
        yield pd.DataFrame({"last": [before[0]], "live": [before[1]], **{k: [v] for k, v in names.items()}})


def judge_batch(rows: DataFrame, before: DataFrame, limit: int | None = SLICE_ROWS) -> DataFrame:
    """(log_pos, KEYS, reason): the orphan tombstones and late records of a batch, given the last record of its keys before it.

    A key of any share of the batch is worked on in slices of at most about ``limit`` records; from slice to slice only the last
    flag is carried, so the slices are judged by several tasks."""
    known = join_skewed(rows, before.select(*KEYS, "last"), KEYS, limit)
    late = F.coalesce(F.col("log_pos") <= F.col("last"), F.lit(False))
    fresh = known.filter(~late).drop("last").unionByName(
        before.select(F.col("last").alias("log_pos"), *KEYS, "live").withColumn("is_new", F.lit(False))
    )
    seen = previous_value(fresh, KEYS, "log_pos", "live", "was_live", limit)
    orphan = F.col("is_new") & ~F.col("live") & ~F.coalesce(F.col("was_live"), F.lit(False))
    found = seen.filter(orphan).select("log_pos", *KEYS, F.lit(ORPHAN).alias("reason"))
    return found.unionByName(known.filter(late).select("log_pos", *KEYS, F.lit(LATE).alias("reason")))


def orphan_job(commits: DataFrame, path: str, limit: int = SLICE_ROWS, keep_seconds: float | None = None) -> Job:
    """Deletes without a live entry.

    The engine's keyed state holds the last position and live flag of each key. It sees one record per task and key, the last
    one, and gives what held before the batch; the batch itself is judged against that in slices, so that no key is held in one
    place. Within a batch any order will do. A record that comes after a later one of its key was judged in an earlier batch
    cannot be judged any more: it goes to the job's table as ``late_record``, apart from the orphans.
    """
    found = ChangeTable(f"{path}/orphans", keep_seconds=keep_seconds)
    rows = commits.select("log_pos", *KEYS, F.col("committed").isNotNull().alias("live"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"last {kinds['log_pos']}", "live boolean", *[f"{c} {kinds[c]}" for c in KEYS]])
    ends = rows.select(F.col("log_pos").alias("last"), "live", *KEYS).mapInPandas(newest_of_task(KEYS, "last"), schema)
    before = ends.groupBy(*KEYS).applyInPandasWithState(
        _state_before, schema, "last bigint, live boolean", "append", GroupStateTimeout.NoTimeout
    )
    tagged = rows.withColumn("last", F.lit(None).cast(kinds["log_pos"])).unionByName(
        before.withColumn("log_pos", F.lit(None).cast(kinds["log_pos"]))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # or the keyed state would be worked on again for each use
        try:
            new = batch.filter("last is null").drop("last").withColumn("is_new", F.lit(True))
            # No key of a small batch can be heavy.
            slices = limit if batch.count() > limit else None
            found.write(judge_batch(new, batch.filter("last is not null").drop("log_pos"), slices), batch_id)
        finally:
            batch.unpersist()

    def orphans(spark: SparkSession) -> DataFrame:
        return found.read(spark).filter(F.col("reason") == ORPHAN).select("log_pos", *KEYS)

    return Job(tagged, "append", write, orphans, found)


def keyed_table(path: str, keys: list[str], keep_seconds: float | None = None, slot_by: str | None = None) -> ChangeTable:
    """A table whose batches give all rows of each key that changed, or one marked as gone for a key that has none."""

    def merge(rows: DataFrame) -> DataFrame:
        newest_batch = F.max("batch_id").over(Window.partitionBy(*keys))
        standing = rows.withColumn("_newest", newest_batch).filter(F.col("_newest") == F.col("batch_id"))
        return standing.filter(~F.col(GONE)).drop("_newest")

    return ChangeTable(path, merge, keep_seconds=keep_seconds, slot_by=slot_by)


def _with_gone(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """The new rows of changed keys, and a row marked as gone for each of these keys that has none."""
    keys = changed.columns
    none = changed.join(rows, keys, "left_anti").withColumn(GONE, F.lit(True))
    return rows.withColumn(GONE, F.lit(False)).unionByName(none, allowMissingColumns=True)


def _differing(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows that only one of two snapshots has."""
    both = now.withColumn("_side", F.lit(1)).unionByName(before.withColumn("_side", F.lit(-1)))
    return both.groupBy(*now.columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0").select(*keys).distinct()


@dataclass
class View:
    """A table that a job keeps, without the columns of its upkeep."""

    table: ChangeTable
    columns: list[str]

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        return self.table.read(spark, upto).select(*self.columns)


@dataclass
class LagTables:
    report: View
    topic_groups: View
    groups: View


_ASSIGNED = [*KEYS, *CONSUMER]


def lag_job(
    topic_log: DataFrame, commits: DataFrame, assignments: Table, groups: Table, path: str, clock: bool = False,
    keep_seconds: float | None = None,
) -> tuple[Job, LagTables]:
    """Keeps the lag report and its views up to date; start it with ``processingTime="2 seconds"``. With ``clock`` it does so
    even when the logs have no new records, as assignments and groups may have changed.

    The engine's state holds the newest commit of each key and the end of each partition, and gives those that a batch changes.
    ``assignments`` and ``groups`` are read anew at each trigger and compared with the last ones. Only keys whose commit, log
    end, members or group state changed are reported anew; a trigger without changes writes nothing. ``as_of`` is the time at
    which a row of the report was last refreshed.
    """

    def kept(name: str, keys: list[str]) -> ChangeTable:
        return keyed_table(f"{path}/{name}", keys, keep_seconds)

    newest_commits = newest_table(f"{path}/commits", KEYS, "committed", "log_pos", keep_seconds)
    last_offsets = ChangeTable(f"{path}/ends", _last_offsets, keep_seconds=keep_seconds)
    assigned, states = kept("assigned", KEYS), kept("states", ["grp"])
    tables = LagTables(
        View(kept("report", KEYS), [*REPORT, "as_of"]),
        View(kept("topic_groups", ["topic", "grp"]), ["topic", "grp"]),
        View(kept("groups", ["grp"]), ["grp", "state", "n_partitions", "total_lag"]),
    )
    written = [newest_commits, last_offsets, assigned, states, *[v.table for v in (tables.report, tables.topic_groups, tables.groups)]]

    # Both logs in one query, so that one refresh sees one state of each.
    commit_rows = commits.select(*KEYS, "committed", "log_pos", F.lit(None).cast("bigint").alias("log_offset"))
    end_rows = topic_log.select(
        F.lit(None).cast("string").alias("grp"), "topic", "part_id",
        F.lit(None).cast("bigint").alias("committed"), F.lit(None).cast("bigint").alias("log_pos"), "log_offset",
    )

    rows = commit_rows.unionByName(end_rows)
    # Joins run in the outer session: in that of the stream, plans do not adapt at run time.
    spark = commits.sparkSession
    if clock:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        rows = rows.unionByName(ticks.select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))
    newest_rows = rows.filter(F.col("topic").isNotNull()).groupBy(*KEYS).agg(
        F.max_by("committed", "log_pos").alias("committed"),
        F.max("log_pos").alias("log_pos"),
        F.max("log_offset").alias("log_offset"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        """Every table is brought from its state before this batch to the one after it, so a batch may be run again."""
        schema = batch.schema
        again = any(t.has(spark, batch_id) for t in written)
        is_commit = F.col("grp").isNotNull()
        batch = batch.persist()
        try:
            n_commits, n_ends = batch.agg(F.count_if(is_commit), F.count_if(~is_commit)).first()
            if n_commits or again:
                newest_commits.write(batch.filter(is_commit).select(*KEYS, "committed", "log_pos"), batch_id)
            if n_ends or again:
                last_offsets.write(batch.filter(~is_commit).select("topic", "part_id", "log_offset"), batch_id)
        finally:
            batch.unpersist()

        def state(table: ChangeTable, like: str, upto: int = batch_id) -> DataFrame:
            """A table after a batch; empty if nothing was written to it."""
            try:
                return table.read(spark, upto)
            except ValueError:
                return spark.createDataFrame([], like)

        def changes(table: ChangeTable, like: str) -> DataFrame:
            return table.changes(spark, batch_id) if table.has(spark, batch_id) else spark.createDataFrame([], like)

        kinds = {f.name: f.dataType.simpleString() for f in schema}
        keys_like = ", ".join(f"{c} {kinds[c]}" for c in KEYS)
        now_assigned = assignments(spark).select(*_ASSIGNED).distinct().persist()
        now_states = groups(spark).select("grp", "state").distinct().persist()
        assigned_like = f"{keys_like}, " + ", ".join(f"{c} string" for c in CONSUMER)
        moved = _differing(state(assigned, assigned_like, batch_id - 1).select(*_ASSIGNED), now_assigned, KEYS).persist()
        turned = _differing(state(states, "grp string, state string", batch_id - 1).select("grp", "state"), now_states, ["grp"]).persist()
        all_commits = state(newest_commits, f"{keys_like}, committed bigint, log_pos bigint")
        report_like = f"{assigned_like}, committed bigint, log_end bigint, lag bigint, as_of timestamp"
        before = state(tables.report.table, report_like, batch_id - 1)
        ended = changes(last_offsets, "topic string, part_id int").select("topic", "part_id")
        affected = (
            changes(newest_commits, keys_like).select(*KEYS)
            .unionByName(before.join(ended, ["topic", "part_id"], "left_semi").select(*KEYS))
            .unionByName(moved)
            .unionByName(all_commits.select(*KEYS).unionByName(now_assigned.select(*KEYS)).join(turned, "grp", "left_semi"))
            .distinct()
            .persist()
        )
        try:
            any_moved, any_turned = not moved.isEmpty(), not turned.isEmpty()
            if any_moved or again:
                assigned.write(_with_gone(now_assigned.join(moved, KEYS, "left_semi"), moved), batch_id)
            if any_turned or again:
                states.write(_with_gone(now_states.join(turned, "grp", "left_semi"), turned), batch_id)
            if affected.isEmpty() and not any_turned and not again:
                return
            offsets = latest(all_commits.join(affected, KEYS, "left_semi"), KEYS, "committed", "log_pos")
            ends = log_end_offsets(state(last_offsets, "topic string, part_id int, log_offset bigint"))
            fresh = lag_report(now_assigned.join(affected, KEYS, "left_semi"), offsets, ends, now_states)
            fresh = stamped(fresh, datetime.datetime.now(datetime.timezone.utc))
            tables.report.table.write(_with_gone(fresh, affected), batch_id)

            report = tables.report.read(spark, batch_id)
            pairs = affected.select("topic", "grp").distinct()
            standing = topic_groups(report.join(pairs, ["topic", "grp"], "left_semi"))
            tables.topic_groups.table.write(_with_gone(standing, pairs), batch_id)
            grps = affected.select("grp").unionByName(turned).distinct()
            snapshot = group_snapshot(report.join(grps, "grp", "left_semi"), now_states.join(grps, "grp", "left_semi"))
            tables.groups.table.write(_with_gone(snapshot, grps), batch_id)
        finally:
            for frame in (now_assigned, now_states, moved, turned, affected):
                frame.unpersist()

    return Job(newest_rows, "update", write, tables.report.read), tables
