"""Scalar expressions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


#: Fixed value: an identifier as logs print it, of four hexadecimal digits; greater ones have more, without zeros before them.
HEX_ID = "(?:[0-9a-fA-F]{4}|[1-9a-fA-F][0-9a-fA-F]{4,})"


def hex_id(column: Column) -> Column:
    """An identifier written in hexadecimal, with or without 0x, as an integer; anything else is null."""
    digits = F.regexp_replace(F.lower(F.trim(column)), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("bigint"))


def hex_display(column: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(column)))


def hex_padded(column: Column, least: int = 4) -> Column:
    """An identifier in hexadecimal of that many digits, or all it has where it has more; lpad alone would cut it."""
    digits = F.lower(F.hex(column))
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(least)), F.lit("0"))


def slot_key(column: Column) -> Column:
    """'frame.slot' as a struct of integers; anything else is null."""
    parts = F.regexp_extract(column, r"^(\d{1,9})\.(\d{1,9})$", 1), F.regexp_extract(column, r"^(\d{1,9})\.(\d{1,9})$", 2)
    return F.when(parts[0] != "", F.struct(parts[0].cast("int").alias("frame"), parts[1].cast("int").alias("slot")))


def scaled_number(column: Column) -> Column:
    """A number with a k, M or G suffix; n/a and the like are null."""
    number = F.regexp_extract(F.trim(column), r"^(-?\d+(?:\.\d+)?)([kMG]?)$", 1)
    unit = F.regexp_extract(F.trim(column), r"^(-?\d+(?:\.\d+)?)([kMG]?)$", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    return F.when(number != "", number.cast("double") * factor)


def triple(column: Column) -> Column:
    """'least/mean/greatest' as a struct."""
    p = F.split(column, "/")
    return F.struct(*(F.try_element_at(p, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(("least", "mean", "greatest"))))


def strip_ansi(column: Column) -> Column:
    return F.regexp_replace(column, r"\x1b\[[0-9;]*[A-Za-z]", "")


def message_name(info: Column) -> Column:
    """The first message named by a packet's summary, without what follows in brackets."""
    return F.nullif(F.trim(F.substring_index(F.substring_index(info, ",", 1), " [", 1)), F.lit(""))


def values(column: Column) -> Column:
    """A field with several comma-joined values as an array."""
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def percent_lost(sent: Column, received: Column) -> Column:
    """0 where nothing was sent; less than 0 where more came than was sent."""
    return F.when(sent == 0, F.lit(0.0)).otherwise(100.0 * (sent - received) / sent)


def time_of_day(t: Column) -> Column:
    """HH:MM:SS.mmm, in universal time, of microseconds since 1970; what is below a millisecond is cut off."""
    of_day = F.pmod(F.floor(t / 1000), F.lit(86_400_000))
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(of_day / 3_600_000, 2), F.lit(":"), part(of_day / 60_000 % 60, 2), F.lit(":"), part(of_day / 1000 % 60, 2), F.lit("."), part(of_day % 1000, 3))


def padded(column: Column, n: int) -> Column:
    """Tab-separated fields as an array of n: cut, or filled with empty ones."""
    parts = F.split(column, "\t")
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


def digest(column: Column) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(column, 256), 1, 16)


def evidence(column: Column, n: int = 80) -> Column:
    """A line cut to n characters."""
    return F.substring(column, 1, n)


def has_field(column: Column, name: str) -> Column:
    """Whether a line gives a field name=..."""
    return F.contains(column, F.lit(f"{name}="))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
