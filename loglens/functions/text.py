"""Text expressions: word splitting and printing of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The record text, its date pattern and the zone it is printed in.
RECORD_FORMAT = "Consumer Record:(key: %s, value: %s, partition: %d, offset: %d, timestamp: %s)"
RECORD_ZONE = "America/Los_Angeles"
RECORD_ZONE_NAMES = {-8: "PST", -7: "PDT"}


def word_pieces(text: Column) -> Column:
    """Lower-case text cut at runs of non-word characters, empty pieces at either end included."""
    return F.split(F.lower(text), r"\W+")


def drop_trailing_empty(pieces: Column) -> Column:
    """Words from pieces: a leading separator gives one empty word, trailing ones give none, text of separators only
    gives no word, empty text gives one empty word."""
    n = F.size(pieces)
    return (
        F.when((n == 1) | (F.element_at(pieces, -1) != ""), pieces)
        .when((n == 2) & (F.element_at(pieces, 1) == ""), F.array().cast("array<string>"))
        .otherwise(F.slice(pieces, 1, n - 1))
    )


def utc_wall_time(ts: Column, has_zone: bool) -> Column:
    """UTC wall time without zone, whatever the session zone is."""
    if not has_zone:
        return ts
    seconds = (F.unix_micros(ts).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def utc_instant(ts: Column) -> Column:
    """The instant of a UTC wall time without zone, whatever the session zone is."""
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.timestamp_micros(seconds.cast("bigint") * 1_000_000 + micros)


def zoned_text(utc: Column, zone: str, names: dict[int, str]) -> Column:
    """``EEE MMM dd HH:mm:ss zzz yyyy`` of a UTC wall time. ``names`` maps the UTC offset in hours to the zone label:
    Spark's own ``zzz`` prints the zone of the session. An offset without a label is an error."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    hours = F.extract(F.lit("HOUR"), local - utc).cast("int")
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[hours]
    missing = F.raise_error(F.concat(F.lit(f"no label for {zone} at UTC offset "), hours.cast("string"))).cast("string")
    return F.concat_ws(
        " ",
        F.date_format(local, "EEE MMM dd HH:mm:ss"),
        F.when(utc.isNotNull(), F.coalesce(label, missing)),
        F.date_format(local, "yyyy"),
    )


def record_text(
    key: Column,
    value: Column,
    part_id: Column,
    offset: Column,
    utc: Column,
    zone: str = RECORD_ZONE,
    names: dict[int, str] = RECORD_ZONE_NAMES,
) -> Column:
    """One record as text; a null key or value prints as ``null``."""
    return F.format_string(RECORD_FORMAT, key, value, part_id, offset, zoned_text(utc, zone, names))


def with_record_text(log: DataFrame, name: str = "text") -> DataFrame:
    """Text records with their print. ``ts`` may be an instant or a UTC wall time without zone."""
    utc = utc_wall_time(F.col("ts"), has_zone=log.schema["ts"].dataType.typeName() == "timestamp")
    text = record_text(F.col("msg_key"), F.col("msg_value"), F.col("part_id"), F.col("log_offset"), utc)
    return log.withColumn(name, text)
