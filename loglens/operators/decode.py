"""Decoding of the binary commit log: routing by version, offset commits, rejects, the version envelope.

A log has ``log_pos bigint, key binary, value binary``. Decoders never stop at a bad record: they set ``reason`` and
leave the rest of the log usable. ``split_rejects`` parts the two, or raises if asked to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.functions.binary import read_i16, read_i32, read_i64, read_text, version_is
from loglens.operators.fence import fence

OFFSET_KEY_VERSION = 1
GROUP_KEY_VERSION = 2

UNKNOWN_KEY = "unknown_key_version"
UNSUPPORTED_VALUE = "unsupported_value_version"
UNKNOWN_VALUE = "unknown_value_version"
DECODE_ERROR = "decode_error"
ORPHAN = "orphan_tombstone"


def key_version(key: Column) -> Column:
    """Leading int16 of the key; null when there is none."""
    return F.when(F.octet_length(key) >= 2, read_i16(key, 1))


def route(log: DataFrame) -> DataFrame:
    """Adds ``key_version`` and ``route``: ``group_metadata``, ``offset_commit`` or ``error``."""
    version = F.col("key_version")
    return log.withColumn("key_version", key_version(F.col("key"))).withColumn(
        "route",
        F.when(version == GROUP_KEY_VERSION, "group_metadata")
        .when(version == OFFSET_KEY_VERSION, "offset_commit")
        .otherwise("error"),
    )


def decode_commits(log: DataFrame) -> DataFrame:
    """Offset commits with their tombstones, and a ``reason`` on each record that is not usable.

    Gives ``log_pos, grp, topic, part_id, is_tombstone, committed, metadata, commit_ms, expire_ms, reason``.
    Group-metadata records are left out before anything else is decoded. Old (version 0) offset values are decoded
    and flagged, as they have no expiry.
    """
    return _commit_fields(log.filter(~is_group(F.col("key"))))


def is_group(key: Column) -> Column:
    """Whether a record is one of group metadata; never null, as the version of a null or short key is."""
    return F.coalesce(version_is(key, GROUP_KEY_VERSION), F.lit(False))


def _commit_fields(rows: DataFrame, *keep: str) -> DataFrame:
    """The fields of ``decode_commits`` for all records, and the columns of ``rows`` named in ``keep``."""
    k, v = F.col("key"), F.col("value")

    # Key: version(2) group(2 + n) topic(2 + m) partition(4).
    s1 = rows.select(
        "log_pos",
        *keep,
        k,
        v,
        key_version(k).alias("kv"),
        read_i16(k, 3).alias("glen"),
        F.when(F.octet_length(v) >= 2, read_i16(v, 1)).alias("vv"),
        # Value: version(2) offset(8) metadata(2 + n) commit time(8), and expiry(8) from version 1 on.
        read_i16(v, 11).alias("mlen"),
    )
    s2 = s1.select("*", read_i16(k, 5 + F.col("glen")).alias("tlen"))
    glen, tlen, mlen, vv = F.col("glen"), F.col("tlen"), F.col("mlen"), F.col("vv")

    key_ok = F.coalesce((glen >= 0) & (tlen >= 0) & (F.octet_length(k) >= 10 + glen + tlen), F.lit(False))
    value_need = F.when(vv == 1, 28 + mlen).otherwise(20 + mlen)
    value_ok = F.coalesce((mlen >= 0) & (F.octet_length(v) >= value_need), F.lit(False))
    reason = (
        F.when(F.col("kv").isNull(), DECODE_ERROR)
        .when(F.col("kv") != OFFSET_KEY_VERSION, UNKNOWN_KEY)
        .when(~key_ok, DECODE_ERROR)
        .when(v.isNull(), F.lit(None))
        .when(vv.isNull(), DECODE_ERROR)
        .when(~vv.isin(0, 1), UNKNOWN_VALUE)
        .when(~value_ok, DECODE_ERROR)
        .when(vv == 0, UNSUPPORTED_VALUE)
    )
    s3 = fence(s2.select("*", reason.alias("reason")), "reason")
    good_key = F.col("reason").isNull() | (F.col("reason") == UNSUPPORTED_VALUE)
    good_value = good_key & v.isNotNull()
    return s3.select(
        "log_pos",
        *keep,
        F.when(good_key, read_text(k, 5, glen)).alias("grp"),
        F.when(good_key, read_text(k, 7 + glen, tlen)).alias("topic"),
        F.when(good_key, read_i32(k, 7 + glen + tlen)).alias("part_id"),
        v.isNull().alias("is_tombstone"),
        F.when(good_value, read_i64(v, 3)).alias("committed"),
        F.when(good_value, read_text(v, 13, mlen)).alias("metadata"),
        F.when(good_value, read_i64(v, 13 + mlen)).alias("commit_ms"),
        F.when(good_value & (vv == 1), read_i64(v, 21 + mlen)).alias("expire_ms"),
        "reason",
    )


def split_rejects(decoded: DataFrame, on_error: str = "reject") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects ``log_pos, reason``). With ``on_error="fail"`` the first bad record fails the job."""
    if on_error == "fail":
        text = F.concat(F.lit("bad record at "), F.col("log_pos").cast("string"), F.lit(": "), F.col("reason"))
        checked = F.when(F.col("reason").isNotNull(), F.raise_error(text).cast("string"))
        # Filtering on the checked column keeps it from being pruned away.
        good = decoded.withColumn("reason", checked).filter(F.col("reason").isNull())
    elif on_error == "reject":
        good = decoded.filter(F.col("reason").isNull())
    else:
        raise ValueError(f"on_error must be 'reject' or 'fail', not {on_error!r}")
    return good.drop("reason"), decoded.filter(F.col("reason").isNotNull()).select("log_pos", "reason")


def expired_commits(commits: DataFrame) -> DataFrame:
    """Tombstones: commits whose value is null."""
    return commits.filter(F.col("committed").isNull()).select("log_pos", "grp", "topic", "part_id")


def open_envelope(rows: DataFrame, data: str, expected: int) -> DataFrame:
    """Splits ``data`` into ``env_version`` (leading int32) and ``body``. A version other than the expected one is
    reported in ``version_ok``; the body is read all the same. Data too short for a version gives null."""
    whole = F.octet_length(data) >= 4
    return (
        rows.withColumn("env_version", F.when(whole, read_i32(F.col(data), 1)))
        .withColumn("body", F.when(whole, F.substring(F.col(data), F.lit(5), F.octet_length(data) - 4)))
        .withColumn("version_ok", F.col("env_version") == expected)
    )
