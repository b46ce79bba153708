"""Column expressions for the big-endian layout of log keys and values.

Integers are big-endian two's complement, a string is an int16 byte length followed by UTF-8, a nullable string
uses length -1, bytes are an int32 length followed by the bytes, an array is an int32 count followed by its items.

Readers take a 1-based byte position and give null when it lies past the end. They do not see a field that is cut
short, so callers compare ``octet_length`` with the length the layout needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def _unsigned(data: Column, pos: Column | int, width: int) -> Column:
    return F.conv(F.hex(F.substring(data, _col(pos), F.lit(width))), 16, 10).cast("bigint")


def _signed(raw: Column, bits: int) -> Column:
    return F.shiftright(F.shiftleft(raw, 64 - bits), 64 - bits).cast("int")


def read_i16(data: Column, pos: Column | int) -> Column:
    return _signed(_unsigned(data, pos, 2), 16)


def read_i32(data: Column, pos: Column | int) -> Column:
    return _signed(_unsigned(data, pos, 4), 32)


def read_i64(data: Column, pos: Column | int) -> Column:
    return F.conv(F.hex(F.substring(data, _col(pos), F.lit(8))), 16, -10).cast("bigint")


def read_text(data: Column, pos: Column | int, length: Column) -> Column:
    """UTF-8 text; malformed bytes become the replacement character, as a lenient decoder gives."""
    return F.make_valid_utf8(F.substring(data, _col(pos), length).cast("string"))


def version_is(data: Column, version: int) -> Column:
    """Tests the leading int16 without decoding it."""
    return F.substring(data, F.lit(1), F.lit(2)) == F.lit(bytearray(version.to_bytes(2, "big", signed=True)))


# The same readers as SQL text, for expressions of very many parts.


def sql_i16(data: str, pos: str) -> str:
    return f"cast(shiftright(shiftleft(cast(conv(hex(substring({data}, {pos}, 2)), 16, 10) as bigint), 48), 48) as int)"


def sql_i32(data: str, pos: str) -> str:
    return f"cast(shiftright(shiftleft(cast(conv(hex(substring({data}, {pos}, 4)), 16, 10) as bigint), 32), 32) as int)"


def sql_text(data: str, pos: str, length: str) -> str:
    return f"make_valid_utf8(cast(substring({data}, {pos}, {length}) as string))"


# Writers turn SQL expressions into SQL expressions that give hex text, so that fields join with concat and array_join;
# unhex() makes the bytes.


def hex_i64(x: str | int) -> str:
    return f"lpad(hex(cast({x} as bigint)), 16, '0')"


def hex_i16(x: str | int) -> str:
    return f"substring({hex_i64(x)}, 13, 4)"


def hex_i32(x: str | int) -> str:
    return f"substring({hex_i64(x)}, 9, 8)"


def hex_text(x: str) -> str:
    """A string; null is written as length -1."""
    return f"case when {x} is null then 'FFFF' else concat({hex_i16(f'octet_length({x})')}, hex(encode({x}, 'UTF-8'))) end"


def hex_bytes(hexed: str) -> str:
    """Length-prefixed bytes, from bytes given as hex text."""
    return f"concat({hex_i32(f'length({hexed}) div 2')}, {hexed})"


def hex_array(items: str, name: str, item: str) -> str:
    """Count-prefixed array; ``item`` is the hex text of one element, called ``name``."""
    return f"concat({hex_i32(f'size({items})')}, array_join(transform({items}, {name} -> {item}), ''))"
