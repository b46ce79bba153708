"""Decoding of group-metadata records, whose members make them variable in shape.

A value is read from front to back: every field gives the position of the next one, members and their lists are walked
by an aggregate whose state is the position and what was read so far. A position is null once a field runs past the end
of its bytes, and so are all positions after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.binary import read_i16, read_text, sql_i16, sql_i32, sql_text, version_is
from loglens.operators.decode import DECODE_ERROR, GROUP_KEY_VERSION, UNKNOWN_VALUE, UNSUPPORTED_VALUE, is_group
from loglens.operators.fence import fence

PARTITION = "struct<topic: string, part_id: int>"
MEMBER = (
    "struct<member_id: string, client_id: string, client_host: string, session_timeout: int, rebalance_timeout: int, "
    f"topics: array<string>, partitions: array<{PARTITION}>>"
)

# The functions below make SQL text, in which a value that is used several times gets a name. Names that callers pass in
# never end in "_", so that they are not hidden by those of these functions.


def _let(name: str, value: str, use: str) -> str:
    """``use`` with a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _room(data: str, at: str) -> str:
    """Bytes from a position to the end."""
    return f"(octet_length({data}) + 1 - ({at}))"


def _after_text(data: str, at: str, nullable: bool = False) -> str:
    least, size = (-1, "greatest(n_, 0)") if nullable else (0, "n_")
    return _let("n_", sql_i16(data, at), f"if(n_ >= {least} and {size} + 2 <= {_room(data, at)}, {at} + 2 + {size}, null)")


def _text(data: str, at: str) -> str:
    return _let("n_", sql_i16(data, at), f"if(n_ >= 0, {sql_text(data, f'{at} + 2', 'n_')}, null)")


def _after_bytes(data: str, at: str) -> str:
    return _let("n_", sql_i32(data, at), f"if(n_ >= 0 and n_ <= {_room(data, at)} - 4, {at} + 4 + n_, null)")


def _items(data: str, at: str, least: int, kind: str, state: str, read: str) -> str:
    """The items of a counted list; null if it is not whole. ``read`` gives the next ``state``, the position and the items
    before it. A count that cannot fit, at ``least`` bytes an item, is not walked."""
    zero = f"named_struct('at', {at} + 4, 'items', cast(array() as array<{kind}>))"
    steps = "if(n_ > 0, sequence(1, n_), cast(array() as array<int>))"
    walked = f"aggregate({steps}, {zero}, ({state}, step_) -> {read}, {state} -> if({state}.at is null, null, {state}.items))"
    fits = f"n_ >= 0 and cast(n_ as bigint) * {least} <= {_room(data, at)} - 4"
    return _let("n_", sql_i32(data, at), f"if({fits}, {walked}, null)")


def _state(at: str, items: str) -> str:
    return f"named_struct('at', {at}, 'items', {items})"


def _topics(data: str) -> str:
    """Version, then names."""
    read = _state(_after_text(data, "t.at"), f"array_append(t.items, {_text(data, 't.at')})")
    return _items(data, "3", 2, "string", "t", read)


def _partitions(data: str) -> str:
    """Version, then names, each with its partition numbers."""
    number = sql_i32(data, "after + i * 4")
    found = f"transform(sequence(1, n), i -> named_struct('topic', {_text(data, 'p.at')}, 'part_id', {number}))"
    fits = f"n >= 0 and cast(n as bigint) * 4 <= {_room(data, 'after')} - 4"
    read = _state(f"if({fits}, after + 4 + n * 4, null)", f"if({fits} and n > 0, concat(p.items, {found}), p.items)")
    read = _let("after", _after_text(data, "p.at"), _let("n", sql_i32(data, "after"), read))
    return _items(data, "3", 6, PARTITION, "p", read)


def _members(data: str, at: str) -> str:
    """Names, time limits, then topics and partitions, each with its length."""
    member = (
        f"named_struct('member_id', {_text(data, 'm.at')}, 'client_id', {_text(data, 'client')}, "
        f"'client_host', {_text(data, 'host')}, 'session_timeout', {sql_i32(data, 'times')}, "
        f"'rebalance_timeout', {sql_i32(data, 'times + 4')}, 'topics', topics, 'partitions', parts)"
    )
    read = _state("if(topics is null or parts is null, null, end)", f"array_append(m.items, {member})")
    for name, value in (
        ("parts", _let("bytes", f"substring({data}, held + 4, end - held - 4)", _partitions("bytes"))),
        ("topics", _let("bytes", f"substring({data}, times + 12, held - times - 12)", _topics("bytes"))),
        ("end", _after_bytes(data, "held")),
        ("held", _after_bytes(data, "times + 8")),
        ("times", _after_text(data, "host")),
        ("host", _after_text(data, "client")),
        ("client", _after_text(data, "m.at")),
    ):
        read = _let(name, value, read)
    return _items(data, at, 22, MEMBER, "m", read)


def _body(data: str) -> Column:
    """The fields of a value of version 1; null if it is not whole."""
    body = (
        f"if(members is null, null, named_struct('protocol_type', {_text(data, '3')}, "
        f"'generation', {sql_i32(data, 'head')}, 'protocol', {_text(data, 'head + 4')}, "
        f"'leader', {_text(data, 'leader')}, 'members', members))"
    )
    for name, value in (
        ("members", _members(data, "listed")),
        ("listed", _after_text(data, "leader", nullable=True)),
        ("leader", _after_text(data, "head + 4", nullable=True)),
        ("head", _after_text(data, "3")),
    ):
        body = _let(name, value, body)
    return F.expr(body)


def _group(key: Column) -> Column:
    """The group of a key; null if the key is cut short."""
    n = read_i16(key, 3)
    return F.when((n >= 0) & (F.octet_length(key) >= 4 + n), read_text(key, 5, n))


def newest_records(log: DataFrame) -> DataFrame:
    """The newest group-metadata record of each group, as it stands in the log: live views need no other, so no other is
    decoded for them. Records whose key is cut short have no group and are left out."""
    rows = log.filter(version_is(F.col("key"), GROUP_KEY_VERSION)).select("log_pos", "key", "value", _group(F.col("key")).alias("grp"))
    newest = F.max_by(F.struct("log_pos", "key", "value"), "log_pos")
    return rows.filter(F.col("grp").isNotNull()).groupBy("grp").agg(newest.alias("r")).select("r.*")


def decode_groups(log: DataFrame) -> DataFrame:
    """``log_pos, grp, protocol_type, generation, protocol, leader, members, is_tombstone, reason`` of the
    group-metadata records."""
    value, version = F.col("value"), F.col("version")
    rows = log.filter(version_is(F.col("key"), GROUP_KEY_VERSION)).select(
        "log_pos", _group(F.col("key")).alias("grp"), "value", F.when(F.octet_length(value) >= 2, read_i16(value, 1)).alias("version")
    )
    decoded = fence(rows.withColumn("body", F.when(version == 1, _body("value"))), "body")
    return decoded.withColumn("reason", _reason()).select(
        "log_pos", "grp", "body.*", (F.col("reason").isNull() & F.col("value").isNull()).alias("is_tombstone"), "reason"
    )


def _reason() -> Column:
    """Why a record is not usable, from its ``grp, value, version, body``; null if it is."""
    version = F.col("version")
    return (
        F.when(F.col("grp").isNull(), DECODE_ERROR)
        .when(F.col("value").isNull(), F.lit(None))
        .when(version.isNull(), DECODE_ERROR)
        .when(version == 0, UNSUPPORTED_VALUE)
        .when(version != 1, UNKNOWN_VALUE)
        .when(F.col("body").isNull(), DECODE_ERROR)
    )


def with_group_reason(log: DataFrame, name: str = "group_reason") -> DataFrame:
    """The log with the reason of its group-metadata records; nothing of other records is read."""
    value, ours = F.col("value"), is_group(F.col("key"))
    rows = log.select(
        "*",
        F.when(ours, _group(F.col("key"))).alias("grp"),
        F.when(ours & (F.octet_length(value) >= 2), read_i16(value, 1)).alias("version"),
    )
    decoded = fence(rows.withColumn("body", F.when(ours & (F.col("version") == 1), _body("value"))), "body")
    return decoded.select(*log.columns, F.when(ours, _reason()).alias(name))


def live_groups(groups: DataFrame) -> DataFrame:
    """The newest record of each group; a group whose newest record is a tombstone is gone.

    Records with a reason are left out. Of a whole log, a group whose newest record is bad is shown by the one
    before; after ``newest_records`` it is not shown, as its state is not known.
    """
    body = F.struct("protocol_type", "generation", "protocol", "leader", "members")
    return (
        groups.filter(F.col("reason").isNull())
        .groupBy("grp")
        .agg(F.max_by(F.when(~F.col("is_tombstone"), body), F.col("log_pos")).alias("body"))
        .filter(F.col("body").isNotNull())
        .select("grp", "body.*")
    )


def group_headers(groups: DataFrame) -> DataFrame:
    return groups.select("grp", "protocol_type", "generation", "protocol", "leader")


def group_members(groups: DataFrame) -> DataFrame:
    """One row per member, with its topics and partitions still as arrays."""
    return groups.select("grp", F.explode("members").alias("m")).select("grp", "m.*")


def member_topics(members: DataFrame) -> DataFrame:
    return members.select("grp", "member_id", F.explode("topics").alias("topic"))


def member_partitions(members: DataFrame) -> DataFrame:
    """The assignments input of the lag report."""
    return members.select(
        "grp", F.col("member_id").alias("consumer_id"), "client_id", F.col("client_host").alias("host"),
        F.explode("partitions").alias("p"),
    ).select("grp", "consumer_id", "client_id", "host", "p.topic", "p.part_id")
