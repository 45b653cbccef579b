"""Search over log blocks, and output within a budget of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running


def matches(*, layer: str | None = None, level: str | None = None, tokens: dict[str, object] | None = None, rnti: int | None = None, pattern: str | None = None, after: str | None = None, before: str | None = None,
            ts: str = "ts", layer_col: str = "layer", level_col: str = "level", text: str = "text", prefix: bool = True) -> Column:
    """One condition, cheap tests first.

    level is a pattern for the whole level; tokens such as ue=5 stand between word bounds;
    rnti is a radio identity in any of its spellings, such as c-rnti=0x4601;
    pattern is tried on the whole text, ignoring case, with ^ and $ at its lines.  A bound
    with a date is compared as a string.  A bound without one is compared with the time of
    day, as far as it is written out if prefix holds, else as a string.
    """
    tests = [F.lit(True)]

    def bound(ref: str) -> Column:
        if "T" in ref:
            return F.col(ts)
        day_time = F.regexp_replace(F.col(ts), r"^.*T", "")
        return F.substring(day_time, 1, len(ref)) if prefix else day_time

    if after:
        tests.append(bound(after) >= after)
    if before:
        tests.append(bound(before) <= before)
    if layer:
        tests.append(F.upper(F.trim(layer_col)) == layer.upper().strip())
    if level:
        tests.append(F.col(level_col).rlike(f"^(?:{level})$"))
    for name, value in (tokens or {}).items():
        tests.append(F.col(text).rlike(rf"\b{name}={value}\b"))
    if rnti is not None:
        tests.append(F.col(text).rlike(rf"(?i)rnti=0x0*{rnti:x}\b"))
    if pattern:
        tests.append(F.col(text).rlike(f"(?im){pattern}"))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def is_config_echo(head: str = "head") -> Column:
    """Whether a block's first line begins the printout of all settings, which searches leave out."""
    return F.col(head).rlike(r"^\S+ \[CONFIG\s*\] \[D\] ") & F.col(head).contains("Input configuration")


def within_budget(frame: DataFrame, lines: str, cap: int, order: list[str], key: list[str] = ()) -> DataFrame:
    """The first rows whose lines together stay within cap, and the first in any case, by key.

    Rows are ordered within a key; no key means one ordered report.
    """
    return running(frame, list(key), order, {"used": F.col(lines), "nth": F.lit(1)}).where((F.col("used") <= cap) | (F.col("nth") == 1)).drop("nth")


def first_events(frame: DataFrame, key: list[str], order: list[str], n: int = 20) -> DataFrame:
    """The first n rows of each key, and how many more there are."""
    who = F.struct(*key).alias("_who")
    held = frame.groupBy(who).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    first = running(frame, key, order, {"nth": F.lit(1)}).where(F.col("nth") <= n)
    return first.withColumn("_who", who).join(held, "_who").drop("_who")


def tail(frame: DataFrame, order: str, n: int, stop: Column | None = None) -> DataFrame:
    """The last n rows before the first one where stop holds."""
    if stop is not None:
        cut = frame.where(stop).agg(F.min(order).alias("cut"))
        frame = frame.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col(order) < F.col("cut"))).drop("cut")  # one row
    return frame.orderBy(F.col(order).desc()).limit(n)
