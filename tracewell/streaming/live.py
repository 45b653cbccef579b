"""Logs that still grow: lines as a stream, counts by time window, and entities that fall silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import logs


def log_lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """value and file of the lines of text files that appear in a folder; a file must be whole when it does."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def events(lines: DataFrame, delay: str = "1 second") -> DataFrame:
    """The lines of radio-node logs parsed, with their time as `time`, under a watermark."""
    return logs.parse_radio(lines).withColumn("time", F.to_timestamp("ts")).withWatermark("time", delay)


def counters(stream: DataFrame, key: list[str], tests: dict[str, Column], width: str = "1 second", slide: str | None = None) -> DataFrame:
    """How many rows of each window meet each test; rows later than the watermark are left out."""
    window = F.window("time", width, slide) if slide else F.window("time", width)
    counted = stream.groupBy(window.alias("window"), *key).agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *key, "n", *tests)


def sessions(stream: DataFrame, key: list[str], silence: str) -> DataFrame:
    """Spans of activity of each key that end when it is silent so long: start, last and n."""
    held = stream.groupBy(F.session_window("time", silence).alias("session"), *key).agg(F.count("*").alias("n"), F.max("time").alias("last"))
    return held.select(*key, F.col("session.start").alias("start"), "last", "n")


def close_pairs(one: DataFrame, other: DataFrame, key: list[str], tolerance: str) -> DataFrame:
    """All pairs of rows of two streams with the same key, no further apart than the tolerance.

    Both have key, id and time under a watermark.  These are candidates: which are kept, one to
    one, is settled by pairing.pair on what has been written.
    """
    a = one.select(*(F.col(k).alias(f"a_{k}") for k in key), F.col("id").alias("a_id"), F.col("time").alias("a_time"))
    b = other.select(*(F.col(k).alias(f"b_{k}") for k in key), F.col("id").alias("b_id"), F.col("time").alias("b_time"))
    same = F.expr(f"b_time >= a_time - interval {tolerance} and b_time <= a_time + interval {tolerance}")
    for k in key:
        same = same & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a.join(b, same).select(*(F.col(f"a_{k}").alias(k) for k in key), "a_id", "b_id", "a_time", "b_time")
