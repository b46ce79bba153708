"""The binary log: bytes built here with struct, decoded by Spark."""

import struct

import pytest
from pyspark.sql import functions as F

from loglens.functions import binary
from loglens.operators import decode, group_metadata, index, rejects
from loglens.plans import inputs
from tests.conftest import rows

LOG = "log_pos bigint, key binary, value binary"


def text(s):
    if s is None:
        return struct.pack(">h", -1)
    raw = s.encode()
    return struct.pack(">h", len(raw)) + raw


def blob(b):
    return struct.pack(">i", len(b)) + b


def offset_key(g, t, p, version=1):
    return struct.pack(">h", version) + text(g) + text(t) + struct.pack(">i", p)


def offset_value(offset, meta, commit, expire):
    return struct.pack(">hq", 1, offset) + text(meta) + struct.pack(">qq", commit, expire)


def member(name, topics, parts):
    subscription = struct.pack(">hi", 0, len(topics)) + b"".join(text(t) for t in topics) + struct.pack(">i", -1)
    assignment = struct.pack(">hi", 0, len(parts)) + b"".join(
        text(t) + struct.pack(">i", len(ps)) + b"".join(struct.pack(">i", p) for p in ps) for t, ps in parts
    ) + struct.pack(">i", -1)
    return (
        text(name) + text("client") + text("/host") + struct.pack(">ii", 10, -1) + blob(subscription) + blob(assignment)
    )


def group_value(protocol, leader, members, version=1):
    return (
        struct.pack(">h", version) + text("consumer") + struct.pack(">i", 7) + text(protocol) + text(leader)
        + struct.pack(">i", len(members)) + b"".join(members)
    )


def test_offset_commits(spark):
    good = [
        (1, offset_key("g", "t", 0), offset_value(5, "m", 10, 20)),
        (2, offset_key("", "", -1), offset_value(-5, "", -1, 2**63 - 1)),
        (3, offset_key("gruppé", "トピック", 2**31 - 1), offset_value(-(2**63), "é", 0, 0)),
        (4, offset_key("g", "t", -(2**31)), None),
        (5, offset_key("g", "t", 1) + b"more", offset_value(1, "x" * 300, 2, 3) + b"more"),
        (7, struct.pack(">hh", 1, 1) + b"\xff" + text("t") + struct.pack(">i", 0), None),
        (6, offset_key("g" * 32767, "t", 1), offset_value(1, "", 2, 3)),
    ]
    log = spark.createDataFrame(good, LOG)
    ok, bad = decode.split_rejects(decode.decode_commits(log))
    assert bad.count() == 0
    got = rows(ok)
    assert got[0] == (1, "g", "t", 0, False, 5, "m", 10, 20)
    assert got[1] == (2, "", "", -1, False, -5, "", -1, 2**63 - 1)
    assert got[2] == (3, "gruppé", "トピック", 2**31 - 1, False, -(2**63), "é", 0, 0)
    assert got[3] == (4, "g", "t", -(2**31), True, None, None, None, None)
    assert got[4] == (5, "g", "t", 1, False, 1, "x" * 300, 2, 3)
    assert len(got[5][1]) == 32767
    assert got[6][1] == "\ufffd"


def test_bad_records(spark):
    key, value = offset_key("g", "t", 0), offset_value(5, "m", 10, 20)
    v0 = struct.pack(">hq", 0, 5) + text("m") + struct.pack(">q", 10)
    cases = [
        (offset_key("g", "t", 0, version=0), value, "unknown_key_version"),
        (offset_key("g", "t", 0, version=7), value, "unknown_key_version"),
        (offset_key("g", "t", 0, version=-1), value, "unknown_key_version"),
        (None, value, "decode_error"),
        (b"", value, "decode_error"),
        (b"\x00", value, "decode_error"),
        (key[:-1], value, "decode_error"),
        (key[:4], value, "decode_error"),
        (struct.pack(">h", 1) + text(None) + text("t") + struct.pack(">i", 0), value, "decode_error"),
        (key, b"", "decode_error"),
        (key, value[:-1], "decode_error"),
        (key, value[:12], "decode_error"),
        (key, struct.pack(">hq", 1, 5) + text(None) + struct.pack(">qq", 1, 2), "decode_error"),
        (key, struct.pack(">h", 9) + value[2:], "unknown_value_version"),
        (key, v0, "unsupported_value_version"),
        (key, v0[:-1], "decode_error"),
    ]
    log = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], LOG)
    decoded = decode.decode_commits(log)
    ok, bad = decode.split_rejects(decoded)
    assert ok.count() == 0
    assert {r[0]: r[1] for r in bad.collect()} == {i: reason for i, (_, _, reason) in enumerate(cases)}
    old = decoded.filter("reason = 'unsupported_value_version'").first()
    assert (old["grp"], old["committed"], old["metadata"], old["commit_ms"], old["expire_ms"]) == ("g", 5, "m", 10, None)


def test_fail_on_error(spark):
    log = spark.createDataFrame([(1, offset_key("g", "t", 0), offset_value(5, "", 1, 2)), (2, b"", None)], LOG)
    with pytest.raises(Exception, match="bad record at 2: decode_error"):
        decode.split_rejects(decode.decode_commits(log), on_error="fail")[0].select("grp").collect()
    with pytest.raises(ValueError):
        decode.split_rejects(decode.decode_commits(log), on_error="skip")


def test_routes(spark):
    log = spark.createDataFrame(
        [(1, offset_key("g", "t", 0), None), (2, struct.pack(">h", 2) + text("g"), None), (3, struct.pack(">h", 5), None), (4, b"", None)],
        LOG,
    )
    assert rows(decode.route(log), "log_pos", "key_version", "route") == [
        (1, 1, "offset_commit"), (2, 2, "group_metadata"), (3, 5, "error"), (4, None, "error"),
    ]


def test_group_metadata(spark):
    def key(g):
        return struct.pack(">h", 2) + text(g)

    three = [member(f"m{i}", ["t", "ü"], [("t", [i, i + 3]), ("ü", [])]) for i in range(3)]
    whole = group_value("range", "m0", three)
    log = spark.createDataFrame(
        [
            (1, key("a"), whole),
            (2, key("b"), group_value(None, None, [])),
            (3, key("c"), group_value("range", "x", [member("x", ["t"], [("t", [0])])])),
            (4, key("c"), None),
            (5, key("d"), whole[:-1]),
            (6, key("e"), group_value("range", "x", [], version=0)),
            (7, key("f"), group_value("range", "x", [], version=3)),
            (8, key("g")[:-1], whole),
            (9, key("h"), group_value("p", "x", [])[:-4] + struct.pack(">i", -2)),
            (10, offset_key("g", "t", 0), None),
            (11, key("i"), b""),
        ],
        LOG,
    )
    ok, bad = decode.split_rejects(group_metadata.decode_groups(log))
    assert {r[0]: r[1] for r in bad.collect()} == {
        5: "decode_error", 6: "unsupported_value_version", 7: "unknown_value_version", 8: "decode_error",
        9: "decode_error", 11: "decode_error",
    }
    live = group_metadata.live_groups(ok)
    assert rows(group_metadata.group_headers(live)) == [
        ("a", "consumer", 7, "range", "m0"), ("b", "consumer", 7, None, None),
    ]
    members = group_metadata.group_members(live)
    assert rows(members, "member_id", "client_id", "client_host", "session_timeout", "rebalance_timeout") == [
        (f"m{i}", "client", "/host", 10, -1) for i in range(3)
    ]
    assert rows(group_metadata.member_topics(members), "member_id", "topic") == [
        (f"m{i}", t) for i in range(3) for t in ("t", "ü")
    ]
    assert rows(group_metadata.member_partitions(members), "consumer_id", "topic", "part_id") == [
        (f"m{i}", "t", p) for i in range(3) for p in (i, i + 3)
    ]


def test_writers_match_struct(spark):
    df = spark.createDataFrame([("é", -3, -(2**40))], "s string, i int, l bigint")
    got = df.selectExpr(
        f"unhex(concat({binary.hex_i16(-2)}, {binary.hex_i32('i')}, {binary.hex_i64('l')})) as n",
        f"unhex(concat({binary.hex_text('s')}, {binary.hex_text('cast(null as string)')})) as t",
        f"unhex({binary.hex_bytes(binary.hex_array('array(1, i)', 'x', binary.hex_i16('x')))}) as a",
    ).first()
    assert bytes(got["a"]) == blob(struct.pack(">ihh", 2, 1, -3))
    assert bytes(got["n"]) == struct.pack(">hiq", -2, -3, -(2**40))
    assert bytes(got["t"]) == text("é") + text(None)


def test_envelope(spark):
    df = spark.createDataFrame([(struct.pack(">i", 1) + b"ab",), (struct.pack(">i", -2),), (b"\x00",), (None,)], "d binary")
    got = decode.open_envelope(df, "d", expected=1).collect()
    assert [(r["env_version"], r["version_ok"]) for r in got[:2]] == [(1, True), (-2, False)]
    assert [bytes(r["body"]) for r in got[:2]] == [b"ab", b""]
    for r in got[2:]:
        assert (r["env_version"], r["body"], r["version_ok"]) == (None, None, None)


def test_group_value_cut_anywhere(spark):
    """No part of a value passes for a whole one, and counts larger than the value are not walked."""
    key = struct.pack(">h", 2) + text("g")
    whole = group_value("range", None, [member("mé", ["t", ""], [("t", [1, 2]), ("", [])]), member("", [], [])])
    log = spark.createDataFrame([(n, key, whole[:n]) for n in range(len(whole) + 1)], LOG).repartition(4)
    got = {r["log_pos"]: r["reason"] for r in group_metadata.decode_groups(log).select("log_pos", "reason").collect()}
    assert got == {n: "decode_error" if n < len(whole) else None for n in range(len(whole) + 1)}

    head = struct.pack(">h", 1) + text("c") + struct.pack(">i", 0) + text("p") + text("l")
    names = text("m") + text("c") + text("h") + struct.pack(">ii", 1, 2)
    empty = blob(struct.pack(">hi", 0, 0))
    for huge in (2**31 - 1, 2**29, -1):
        many = struct.pack(">i", huge)
        one = head + struct.pack(">i", 1) + names
        bad = [
            head + many,
            one + many + empty,
            one + blob(b"\0\0" + many) + empty,
            one + empty + blob(b"\0\0" + many),
            one + empty + blob(struct.pack(">hi", 0, 1) + text("t") + many),
        ]
        log = spark.createDataFrame([(i, key, v) for i, v in enumerate(bad)], LOG)
        assert {r["reason"] for r in group_metadata.decode_groups(log).collect()} == {"decode_error"}


def test_newest_group_records(spark):
    def key(g):
        return struct.pack(">h", 2) + text(g)

    log = spark.createDataFrame(
        [
            (1, key("a"), group_value("old", "x", [])), (5, key("a") + b"more", group_value("new", "x", [])),
            (2, key("b"), group_value("old", "x", [])), (3, key("b"), None),
            (2, key("c"), group_value("old", "x", [])), (4, key("c"), b"\0"),
            (6, key("d")[:-1], group_value("p", "x", [])), (7, offset_key("a", "t", 0), None),
        ],
        LOG,
    )
    newest = group_metadata.newest_records(log)
    assert rows(newest, "log_pos") == [(3,), (4,), (5,)]
    live = group_metadata.live_groups(group_metadata.decode_groups(newest))
    assert rows(live, "grp", "protocol") == [("a", "new")]
    assert rows(group_metadata.live_groups(group_metadata.decode_groups(log)), "grp", "protocol") == [("a", "new"), ("c", "old")]


@pytest.mark.parametrize("block", [1, 7, 64, rejects.BLOCK])
def test_one_pass_over_all_records(spark, events, block):
    """Good rows and rejects as the two decoders give them, orphans as the operator over good rows does."""
    log = inputs.binary_log(events, damaged=True).repartition(5)
    tagged, seen = rejects.counted(rejects.tag(log), f"log-{block}")
    commits = decode.decode_commits(log)
    good, bad = decode.split_rejects(commits)
    _, bad_groups = decode.split_rejects(group_metadata.decode_groups(log))
    want = bad.unionByName(bad_groups)
    assert rows(tagged.filter("reason is not null"), "log_pos", "reason") == rows(want)
    fields = ["log_pos", "grp", "topic", "part_id", "committed", "commit_ms", "expire_ms"]
    assert rows(tagged.filter("kind = 'offset_commit' and reason is null"), *fields) == rows(good, *fields)
    assert seen.get == {"n": log.count(), "n_rejects": want.count()}
    orphans = index.orphan_tombstones(good).select("log_pos", F.lit(decode.ORPHAN).alias("reason"))
    assert rows(rejects.rejected(rejects.tag(log), block)) == rows(want.unionByName(orphans))
