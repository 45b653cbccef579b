"""Clocks of several sources: dates of times of day, and how far apart they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import previous, running

DAY = 86_400_000_000


def dated(frame: DataFrame, anchors: DataFrame, key: list[str], order: str, time: str = "ts") -> DataFrame:
    """t, in microseconds, of times of day; anchors have the key and the date on which its rows begin.

    Where a time is more than twelve hours before the one before it, a day has passed.  Rows
    whose key has no anchor, or whose time cannot be read, have a null t.
    """
    of_day = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.col(time))).cast("timestamp_ntz"))
    timed = frame.withColumn("_day_time", of_day)
    before = previous(timed.where("_day_time is not null"), key, [order], {"_before": F.col("_day_time")})
    passed = (F.col("_before") - F.col("_day_time") > DAY // 2).cast("bigint")
    walked = running(before, key, [order], {"_days": passed}).join(anchors.select(*key, F.col("date").cast("date").alias("date")), key, "left")
    t = F.unix_date("date").cast("bigint") * DAY + F.col("_days") * DAY + F.col("_day_time")
    unread = timed.where("_day_time is null").select(*frame.columns, F.lit(None).cast("bigint").alias("t"))
    return walked.select(*frame.columns, t.alias("t")).unionByName(unread)


def first_times(frame: DataFrame, key: list[str], order: str, time: str = "t") -> DataFrame:
    """The time of the first row, in order, that has one."""
    return frame.groupBy(*key).agg(F.min_by(time, F.when(F.col(time).isNotNull(), F.col(order))).alias("first"))


def offsets(log: DataFrame, capture: DataFrame, key: list[str], limit: int = 1_000_000) -> DataFrame:
    """How much later a log has an event than a capture, and whether they share a clock; both have one row (key, first) a key."""
    both = log.withColumnRenamed("first", "log_t").join(capture.withColumnRenamed("first", "capture_t"), key)
    return both.withColumn("offset", F.col("log_t") - F.col("capture_t")).withColumn("shared", F.abs("offset") < limit)
