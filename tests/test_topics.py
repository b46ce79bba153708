import pytest
from pyspark.sql import functions as F

from loglens.functions.text import with_record_text
from loglens.operators import latest, sets, topics
from loglens.sources import topics as source
from tests.conftest import rows

SPECS = "topic string, msg_key string, n bigint, start bigint, message string"


def test_generate_records(spark):
    specs = spark.createDataFrame(
        [("t", "k", 25, 100, "any text"), ("t", "gone", 5, 0, None), ("u", "none", 0, 0, "x"), ("u", "no", 0, 0, None)], SPECS
    )
    for block in (3, 10_000):
        got = rows(source.generate_records(specs, block))
        assert got == sorted([("t", "k", 100 + i, f"t{100 + i}") for i in range(25)] + [("t", "gone", 0, None)], key=repr)


def test_write_read_and_delete(spark, tmp_path, capsys):
    """Five records for each of two keys, then one tombstone: only the other key stays."""
    path = str(tmp_path / "log")

    def send(*specs):
        records = source.place(source.generate_records(spark.createDataFrame(list(specs), SPECS)))
        source.write_topic(source.number_offsets(records, "seq", source.log_ends(spark, path)), path)

    send(("curd", "delete", 5, 0, "hello"), ("curd", "staying", 5, 0, "hello"))
    send(("curd", "delete", 1, 5, None), ("other", "staying", 1, 0, "hello"))
    log = source.text_records(source.read_topic(spark, ["curd"], path))
    assert log.count() == 11
    assert log.groupBy("part_id").agg((F.max("log_offset") + 1 == F.count("*")).alias("dense")).filter("not dense").count() == 0
    assert rows(latest.latest(log, ["topic", "msg_key"], "msg_value", "log_offset")) == [("curd", "staying", "curd4")]
    everything = source.read_topic(spark, path=path)
    assert everything.count() == 12
    assert rows(topics.topic_list(everything)) == [("curd",), ("other",)]
    source.read_topic(spark, ["curd"], path).explain("formatted")
    assert "PartitionFilters: [isnotnull(topic" in capsys.readouterr().out


def test_lookup_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "table")
    spark.createDataFrame([("a", "1"), ("b", "null"), ("c", None)], "msg_key string, msg_value string").write.parquet(path)
    found = latest.lookup(spark.read.parquet(path), "msg_key", "b")
    assert rows(found) == [("b", "null")]
    found.explain("formatted")
    assert "EqualTo(msg_key,b)" in capsys.readouterr().out


def test_broker_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        source.read_topic(spark, ["a", "b"], servers="localhost:9092")
    with pytest.raises(ValueError):
        source.read_topic(spark, ["a"])
    with pytest.raises(ValueError):
        source.stream_topic(spark, ["a"], path="x", servers="y")


def test_internal_topics(spark):
    log = spark.createDataFrame([("a",), ("__consumer_offsets",), ("a",)], "topic string")
    assert rows(topics.topic_list(log)) == [("a",)]
    assert rows(topics.topic_list(log, include_internal=True)) == [("__consumer_offsets",), ("a",)]


def test_registrations(spark):
    df = spark.createDataFrame(
        [
            ("a", '{"version":"1","partitions":{"1":[1,2],"0":[3,1,2]}}'),
            ("b", '{"version":1,"partitions":{"0":[7]}}'),
            ("broken", "{nonsense"),
            ("empty", "{}"),
            ("none", None),
        ],
        "topic string, j string",
    )
    good, bad = topics.parse_registrations(df, "j")
    assert rows(bad) == [("broken", "decode_error"), ("empty", "decode_error"), ("none", "decode_error")]
    infos = topics.partition_infos(good)
    assert rows(topics.partition_counts(good)) == [("a", 2), ("b", 1)]
    assert rows(topics.replica_counts(infos)) == [("a", 5), ("b", 1)]
    assert rows(topics.replication_factor(infos)) == [("a", 3), ("b", 1)]
    assert rows(topics.partition_summary(infos)) == [("a", 2, 5), ("b", 1, 1)]
    named = spark.createDataFrame([("b",), ("b",), ("missing",)], "topic string")
    assert rows(topics.topic_partitions(named, infos), "topic", "part_id") == [("b", 0)]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
def test_zoneless_time_is_utc_in_a_log(spark, tmp_path, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        records = spark.sql(
            "select 't' as topic, 0 as part_id, 0L as log_offset, 'k' as msg_key, 'v' as msg_value, "
            "timestamp_ntz'2024-01-01 00:00:00.25' as ts"
        )
        sent = source.write_topic(records, str(tmp_path / "log"))
        assert rows(sent) == [("t", 0, 0, "k")]
        log = with_record_text(source.text_records(source.read_topic(spark, path=str(tmp_path / "log"))))
        want = "Consumer Record:(key: k, value: v, partition: 0, offset: 0, timestamp: Sun Dec 31 16:00:00 PST 2023)"
        assert [r["text"] for r in log.collect()] == [want] == [r["text"] for r in with_record_text(records).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.sql("select 't' as topic, 0 as part_id, 0L as log_offset, 'k' as msg_key, 'v' as msg_value")
    for _ in range(2):
        source.write_topic(one, path, batch="7")
    assert source.read_topic(spark, path=path).count() == 1
    source.write_topic(one, path)
    assert source.read_topic(spark, path=path).count() == 2


def test_value_sets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "b"), ("z", None), (None, "q")], "k string, v string")
    assert rows(sets.value_sets(sets.key_values(df, "k", "v"), "k", "v")) == [("a", 0, ["b", "x"])]
