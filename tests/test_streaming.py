"""Streams over several micro-batches end in the table of the batch form."""

import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loglens.operators import decode, group_metadata, hot_keys, index, lag, latest, sets, words
from loglens.plans import inputs
from loglens.sources import topics as source
from loglens.streaming import expiry, jobs
from loglens.streaming.tables import ChangeTable
from tests.conftest import SMALL, rows


def staged(spark, df, path, order=None):
    """Writes several files, in order or shuffled, and streams them one per micro-batch."""
    parts = df.repartitionByRange(5, order) if order else df.repartition(5)
    # One append per part, oldest first: the source takes files by age.
    marked = parts.withColumn("_p", F.spark_partition_id()).persist()
    for p in range(5):
        marked.filter(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(path)
    marked.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(job, tmp_path):
    return job.run(str(tmp_path / "checkpoint"))


def batches(tmp_path):
    return len(list((tmp_path / "checkpoint" / "commits").glob("[0-9]*")))


def test_latest_out_of_order_and_with_tombstones(spark, events, tmp_path):
    records = inputs.topic_records(events)
    stream = staged(spark, records, str(tmp_path / "in"))
    job = jobs.latest_job(stream, ["topic", "msg_key"], "msg_value", "log_pos", str(tmp_path / "out"))
    assert rows(run(job, tmp_path)) == rows(latest.latest(records, ["topic", "msg_key"], "msg_value", "log_pos"))
    assert batches(tmp_path) == 5


def test_restart_after_failure(spark, events, tmp_path):
    records = inputs.topic_records(events)
    stream = staged(spark, records, str(tmp_path / "in"))
    job = jobs.latest_job(stream, ["topic", "msg_key"], "msg_value", "log_pos", str(tmp_path / "out"))
    write = job.write

    def fails_once_written(df, batch_id):
        write(df, batch_id)
        if batch_id == 2:
            raise RuntimeError("lost after the write")

    job.write = fails_once_written
    with pytest.raises(Exception, match="lost after the write"):
        run(job, tmp_path)
    job.write = write
    assert rows(run(job, tmp_path)) == rows(latest.latest(records, ["topic", "msg_key"], "msg_value", "log_pos"))


def test_word_count(spark, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    stream = staged(spark, documents, str(tmp_path / "in"))
    got = run(jobs.word_count_job(stream, "text", str(tmp_path / "out")), tmp_path)
    assert rows(got) == rows(words.word_count(words.tokens(documents, "text")))


def test_counts_published_to_a_topic(spark, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    stream = staged(spark, documents, str(tmp_path / "in"))
    job = jobs.word_count_job(stream, "text", str(tmp_path / "out"))
    path = str(tmp_path / "log")
    counts = run(jobs.publish(job, "counts", "word", "n", path=path), tmp_path)
    log = source.text_records(source.read_topic(spark, ["counts"], path)).persist()
    sent = latest.latest(log, ["msg_key"], "msg_value", "log_offset")
    assert log.count() > sent.count() == counts.count()
    assert rows(sent.select("msg_key", F.col("msg_value").cast("bigint"))) == rows(counts)
    offsets = log.groupBy("part_id").agg(F.count("*").alias("n"), F.countDistinct("log_offset").alias("d"), (F.max("log_offset") + 1).alias("e"))
    assert all(r["n"] == r["d"] == r["e"] for r in offsets.collect())


def test_publish_again_after_failure(spark, tmp_path, monkeypatch):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(40)
    stream = staged(spark, documents, str(tmp_path / "in"))
    path = str(tmp_path / "log")

    def published():
        return jobs.publish(jobs.word_count_job(stream, "text", str(tmp_path / "out")), "counts", "word", "n", path=path)

    write = jobs.write_topic

    def fails_once_written(*args, **how):
        write(*args, **how)
        if how["batch"] == "2":
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(jobs, "write_topic", fails_once_written)
    with pytest.raises(Exception, match="lost after the write"):
        run(published(), tmp_path)
    monkeypatch.setattr(jobs, "write_topic", write)
    counts = run(published(), tmp_path)
    log = source.text_records(source.read_topic(spark, ["counts"], path))
    assert log.count() == log.select("part_id", "log_offset").distinct().count()
    sent = latest.latest(log, ["msg_key"], "msg_value", "log_offset")
    assert rows(sent.select("msg_key", F.col("msg_value").cast("bigint"))) == rows(counts)


def test_late_records_are_no_orphans(spark, tmp_path):
    schema = "log_pos bigint, grp string, topic string, part_id int, committed bigint"
    path = str(tmp_path / "in")
    for part in ([(1, "g", "t", 0, 5), (4, "g", "t", 0, 6)], [(2, "g", "t", 0, None), (5, "g", "t", 0, None), (6, "g", "t", 0, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    job = jobs.orphan_job(stream, str(tmp_path / "out"))
    assert rows(run(job, tmp_path)) == [(6, "g", "t", 0)]
    assert rows(job.table.read(spark), "log_pos", "reason") == [(2, jobs.LATE), (6, decode.ORPHAN)]


def test_sets(spark, tmp_path):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_custkey", "o_orderpriority")
    stream = staged(spark, orders, str(tmp_path / "in"))
    got = run(jobs.key_values_job(stream, "o_custkey", "o_orderpriority", str(tmp_path / "out")), tmp_path)
    assert rows(got) == rows(sets.key_values(orders, "o_custkey", "o_orderpriority"))
    assert got.count() == got.distinct().count()


@pytest.mark.parametrize("expire", [False, True])
def test_index(spark, events, tmp_path, expire):
    commits = inputs.commit_log(events)
    stream = staged(spark, commits, str(tmp_path / "in"))
    got = run(jobs.index_job(stream, str(tmp_path / "out"), expire), tmp_path)
    assert rows(got) == rows(index.live(commits) if expire else index.ever_seen(commits))
    assert rows(index.dump(got)) == rows(index.dump(index.live(commits) if expire else index.ever_seen(commits)))


def test_binary_log_to_index(spark, events, tmp_path):
    """From the bytes of a damaged log, by way of the decoder, to the index and to the table of rejects."""
    log = inputs.binary_log(events, damaged=True)
    stream = staged(spark, log, str(tmp_path / "in"))
    good, bad = decode.split_rejects(decode.decode_commits(stream))
    got = run(jobs.index_job(good, str(tmp_path / "out"), expire=True), tmp_path)
    rejects = jobs.append_job(bad, str(tmp_path / "bad")).run(str(tmp_path / "bad-checkpoint"))
    groups = jobs.append_job(
        group_metadata.decode_groups(stream).select("grp", "reason"), str(tmp_path / "groups")
    ).run(str(tmp_path / "groups-checkpoint"))
    want_good, want_bad = decode.split_rejects(decode.decode_commits(log))
    assert rows(got) == rows(index.live(want_good))
    assert rows(rejects) == rows(want_bad)
    assert rows(groups) == rows(group_metadata.decode_groups(log), "grp", "reason")


def test_orphans_across_batches(spark, events, tmp_path):
    commits = inputs.commit_log(events)
    stream = staged(spark, commits, str(tmp_path / "in"), order="log_pos")
    got = run(jobs.orphan_job(stream, str(tmp_path / "out")), tmp_path)
    assert batches(tmp_path) == 5
    assert rows(got) == rows(index.orphan_tombstones(commits))


def test_lag_report(spark, events, tmp_path):
    topic_log, commits = inputs.topic_log(events), inputs.commit_log(events)
    path = str(tmp_path / "log")
    source.write_topic(topic_log, path)
    stream = source.text_records(source.stream_topic(spark, path=path, options={"maxFilesPerTrigger": "2"}))
    commit_stream = staged(spark, commits, str(tmp_path / "in"))
    event_file = f"{SMALL}/events.parquet"
    job, tables = jobs.lag_job(
        stream, commit_stream,
        lambda s: inputs.assignments(s.read.parquet(event_file)),
        lambda s: inputs.groups(s.read.parquet(event_file)),
        str(tmp_path / "out"),
    )
    got = run(job, tmp_path)
    assert batches(tmp_path) >= 3
    groups = inputs.groups(events)
    report = lag.lag_report(inputs.assignments(events), lag.latest_commits(commits), lag.log_end_offsets(topic_log), groups)
    assert rows(got, *lag.REPORT) == rows(report)
    assert rows(tables.groups.read(spark)) == rows(lag.group_snapshot(report, groups))
    assert rows(tables.topic_groups.read(spark)) == rows(lag.topic_groups(report))


def test_lag_report_is_refreshed_on_a_timer(spark, events, tmp_path):
    """A change of the assignments shows up though the logs have no new records."""
    topic_log, commits = inputs.topic_log(events), inputs.commit_log(events)
    logs = []
    for name, df in (("topic", topic_log), ("commits", commits)):
        df.write.parquet(str(tmp_path / name))
        logs.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    member = spark.createDataFrame(
        [("cg-0", "view", 99, "new", "cl", "/h")],
        "grp string, topic string, part_id int, consumer_id string, client_id string, host string",
    )
    assigned = {"now": inputs.assignments(events)}
    job, tables = jobs.lag_job(
        *logs, lambda s: assigned["now"], lambda s: inputs.groups(events), str(tmp_path / "out"), clock=True
    )
    query = job.start(str(tmp_path / "checkpoint"), processingTime="1 second")

    def wait_for(n_rows):
        deadline = time.time() + 60
        while time.time() < deadline:
            try:
                if tables.report.read(spark).filter("part_id = 99").count() == n_rows:
                    return True
            except ValueError:
                pass
            time.sleep(0.5)
        return False

    try:
        assert wait_for(0)
        assigned["now"] = assigned["now"].unionByName(member)
        assert wait_for(1)
    finally:
        query.stop()


def folders(path):
    return sorted(int(p.name.split("=")[-1]) for p in path.iterdir() if p.is_dir()) if path.exists() else []


def test_compaction(spark, tmp_path):
    table = ChangeTable(
        str(tmp_path / "t"), lambda df: latest.newest(df, ["k"], "v", "batch_id"), compact_every=2
    )
    want, states = {}, {}
    for b in range(9):
        change = {f"k{b % 3}": b, "always": b * 10}
        want.update(change)
        states[b] = sorted(want.items())
        for _ in range(2):  # a batch may be run again
            table.write(spark.createDataFrame(list(change.items()), "k string, v int"), b)
        assert rows(table.read(spark), "k", "v") == states[b]
        if b:
            assert rows(table.read(spark, upto=b - 1), "k", "v") == states[b - 1]
    assert folders(tmp_path / "t" / "rows" / "kind=base") == [2, 4, 6, 8]
    assert folders(tmp_path / "t" / "rows" / "kind=delta") == list(range(9))
    table.keep_seconds = 0
    table.write(spark.createDataFrame([("k0", 9)], "k string, v int"), 9)
    assert rows(table.read(spark), "k", "v") == sorted({**want, "k0": 9}.items())
    assert folders(tmp_path / "t" / "rows" / "kind=base") == [8]
    assert folders(tmp_path / "t" / "rows" / "kind=delta") == [9]


def test_bytes_grow_with_the_changes(spark, tmp_path, monkeypatch):
    """Over 500 batches, a table with many keys and one with few are written at most three times. The batches are written
    without Spark, to be quick; bases are written as ever."""
    put = ChangeTable._put

    def put_quickly(self, df, kind, batch_id):
        if kind == "base":
            return put(self, df, kind, batch_id)
        ids = range(batch_id * 10, batch_id * 10 + 10)
        folder = tmp_path / self.path / "rows" / "kind=delta" / f"batch_id={batch_id}"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table({"k": pa.array([i % n_keys for i in ids], pa.int64()), "v": pa.array(ids, pa.int64())}), folder / "part-0.parquet")

    monkeypatch.setattr(ChangeTable, "_put", put_quickly)
    some = spark.range(1)
    for name, n_keys in (("many", 5000), ("few", 20)):
        path = tmp_path / name
        table = ChangeTable(str(path), lambda df: latest.newest(df, ["k"], "v", "batch_id"))
        for b in range(500 if name == "many" else 150):
            table.write(some, b)
        size = {kind: [sum(f.stat().st_size for f in d.iterdir()) for d in (path / "rows" / f"kind={kind}").iterdir()] for kind in ("delta", "base")}
        assert len(size["delta"]) == b + 1 and len(size["base"]) >= 2
        assert sum(size["delta"]) + sum(size["base"]) < 3 * sum(size["delta"]) + max(size["base"])
        want = {i % n_keys: i for i in range(10 * b + 10)}
        assert rows(table.read(spark), "k", "v") == sorted(want.items(), key=repr)


def test_append_tables_are_not_written_again(spark, tmp_path):
    table = ChangeTable(str(tmp_path / "t"), compact_every=2, keep_seconds=0)
    for b in range(8):
        table.write(spark.createDataFrame([(b,)], "x int"), b)
    assert folders(tmp_path / "t" / "rows" / "kind=base") == []
    assert rows(table.read(spark), "x") == [(b,) for b in range(8)]


def test_keyed_table_replaces_the_rows_of_a_key(spark, tmp_path):
    table = jobs.keyed_table(str(tmp_path / "t"), ["k"])
    schema = "k string, x int, gone boolean"
    table.write(spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 3, False)], schema), 0)
    table.write(spark.createDataFrame([("a", 4, False), ("b", None, True)], schema), 2)
    assert rows(table.read(spark), "k", "x") == [("a", 4)]
    assert rows(table.read(spark, upto=1), "k", "x") == [("a", 1), ("a", 2), ("b", 3)]


def test_half_written_batch_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    table = ChangeTable(path)
    with pytest.raises(ValueError, match="nothing has been written"):
        table.read(spark)
    table.write(spark.createDataFrame([("a",)], "k string"), 0)
    table._put(spark.createDataFrame([("b",)], "k string"), "delta", 1)
    assert rows(table.read(spark), "k") == [("a",)]
    table.write(spark.createDataFrame([("c",)], "k string"), 1)
    assert rows(table.read(spark), "k") == [("a",), ("c",)]


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_hot_key_of_a_batch_is_judged_in_slices(spark, tmp_path, limit):
    """A key with 90 % of every batch, null groups, late records and repeated positions."""
    rng = random.Random(4)
    data = []
    for pos in range(600):
        key = ("g", "t", 0) if rng.random() < 0.9 else (rng.choice(["h", None]), "t", rng.randrange(2))
        data.append((pos, *key, None if rng.random() < 0.4 else 1))
    batches = [data[:200], data[200:400] + data[150:160], data[400:] + data[:5]]
    last, want = {}, []
    for batch in batches:
        new = {}
        for pos, *key, value in sorted(batch, key=lambda r: r[0]):
            key = tuple(key)
            if key in last and pos <= last[key][0]:
                want.append((pos, jobs.LATE))
                continue
            before = new.get(key) or last.get(key)
            if value is None and not (before and before[1]):
                want.append((pos, decode.ORPHAN))
            new[key] = (pos, value is not None)
        last.update(new)
    path = str(tmp_path / "in")
    schema = "log_pos bigint, grp string, topic string, part_id int, committed bigint"
    for batch in batches:
        rng.shuffle(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    job = jobs.orphan_job(stream, str(tmp_path / "out"), limit=limit)
    run(job, tmp_path)
    assert rows(job.table.read(spark), "log_pos", "reason") == sorted(want, key=repr)


def test_slices_of_a_hot_batch_key(spark):
    rows_ = spark.range(10_000).selectExpr("id as log_pos", "'g' as grp", "'t' as topic", "0 as part_id", "id % 3 = 0 as live")
    sizes = hot_keys.with_slices(rows_, index.KEYS, "log_pos", 500).groupBy("_slice").count().collect()
    assert len(sizes) >= 18 and max(r["count"] for r in sizes) <= 1100
    ends = [r for part in expiry.newest_of_task(index.KEYS, "last")(iter([rows_.selectExpr("log_pos as last", "live", "grp", "topic", "part_id").toPandas()] * 3)) for r in part.itertuples()]
    assert [(r.last, r.live) for r in ends] == [(9999, True)]


def test_lag_report_follows_changes(spark, tmp_path):
    """Each step changes one thing; the report is that of a fresh start, and only the keys concerned are written."""
    assigned = [("g", "t", 0, "c1", "h", "x"), ("g", "t", 1, "c1", "h", "x"), ("g", "t", 1, "c2", "h", "x"), ("k", "u", 0, "c3", "h", "x")]
    states = {"g": "Stable", "k": "Stable", "d": "Dead"}
    now = {"assigned": assigned, "states": states}
    columns = "grp string, topic string, part_id int, consumer_id string, host string, client_id string"
    read_assigned = lambda s: s.createDataFrame(now["assigned"], columns)
    read_states = lambda s: s.createDataFrame(list(now["states"].items()), "grp string, state string")
    empty = "grp string, topic string, part_id int, committed bigint, log_pos bigint, log_offset bigint"
    topic_log = spark.readStream.schema("topic string, part_id int, log_offset bigint").parquet(str(tmp_path))
    commit_log = spark.readStream.schema("grp string, topic string, part_id int, committed bigint, log_pos bigint").parquet(str(tmp_path))
    job, tables = jobs.lag_job(topic_log, commit_log, read_assigned, read_states, str(tmp_path / "out"))
    commits, ends = {}, {}

    def step(batch_id, new_commits=(), new_ends=()):
        """Keys that the batch wrote to the report, or none."""
        commits.update(((g, t, p), (c, pos)) for g, t, p, c, pos in new_commits)
        ends.update(((t, p), o) for t, p, o in new_ends)
        batch = [(*c, None) for c in new_commits] + [(None, t, p, None, None, o) for t, p, o in new_ends]
        for _ in range(2 if batch_id in (0, 5) else 1):  # a batch may be run again
            job.write(spark.createDataFrame(batch, empty), batch_id)
        offsets = spark.createDataFrame([(*k, c) for k, (c, _) in commits.items() if c is not None], "grp string, topic string, part_id int, committed bigint")
        log_ends = spark.createDataFrame([(*k, o + 1) for k, o in ends.items()], "topic string, part_id int, log_end bigint")
        want = lag.lag_report(read_assigned(spark), offsets, log_ends, read_states(spark))
        assert rows(tables.report.read(spark), *lag.REPORT) == rows(want)
        assert rows(tables.topic_groups.read(spark)) == rows(lag.topic_groups(want))
        assert rows(tables.groups.read(spark)) == rows(lag.group_snapshot(want, read_states(spark)))
        table = tables.report.table
        return {tuple(r) for r in table.changes(spark, batch_id).select(*index.KEYS).collect()} if table.has(spark, batch_id) else None

    assert len(step(0, [("g", "t", 0, 5, 1), ("d", "t", 0, 7, 2), ("k", "u", 1, 3, 3)], [("t", 0, 9), ("u", 0, 4)])) == 5
    assert step(1) is None
    assert step(2, [("g", "t", 0, 6, 4)]) == {("g", "t", 0)}
    assert step(3, [], [("u", 0, 8)]) == {("k", "u", 0)}
    now["assigned"] = assigned[:2] + assigned[3:]
    assert step(4) == {("g", "t", 1)}
    now["states"] = {"g": "Stable", "k": "Dead", "d": "Stable"}
    assert step(5) == {("k", "u", 0), ("k", "u", 1), ("d", "t", 0)}
    assert step(6, [("d", "t", 0, None, 9)]) == {("d", "t", 0)}
    now["states"] = {"g": "Empty", "d": "Stable"}
    step(7)
    assert step(8) is None and not (tmp_path / "out" / "commits" / "rows" / "kind=delta" / "batch_id=8").exists()


def test_keys_expire_after_their_time(spark, tmp_path):
    """Off by default; with a time to live, a key without records for that time leaves the table, others stay."""
    schema = "k string, v string, pos bigint"
    path = str(tmp_path / "in")

    def add(*records):
        spark.createDataFrame(records, schema).coalesce(1).write.mode("append").parquet(path)
        return jobs.latest_job(spark.readStream.schema(schema).parquet(path), ["k"], "v", "pos", str(tmp_path / "out"), ttl_seconds=ttl)

    ttl = 20
    assert rows(run(add(("a", "1", 1), ("b", "2", 2), ("a", "3", 3), ("c", None, 4)), tmp_path)) == [("a", "3"), ("b", "2")]
    assert rows(run(add(("a", "0", 0), ("d", "5", 5)), tmp_path)) == [("a", "3"), ("b", "2"), ("d", "5")]
    time.sleep(21)
    assert rows(run(add(("e", "6", 6), ("d", "7", 7)), tmp_path)) == [("d", "7"), ("e", "6")]
