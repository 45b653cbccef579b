"""Running sums and rows before, by key, with a key's rows in many tasks.

A window by key puts a key's rows, and without a key the whole table, into one task.  Here rows
are dealt in ranges of key and order, so that a key with many rows fills many ranges.  Sums are
run within each range; what a range begins with is the sum over the ranges before it that hold
its first key, and that is a table of one row a range, which is broadcast and added.  So is the
last row of the range before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import store

SPLIT, WHO, FIRST = "_split", "_who", "_first"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def running(frame: DataFrame, key: list[str], order: list[Column | str], sums: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """frame with sums over its key's rows so far, each row's own value included; null values count as 0.

    Keys that are null are a key like others, and no key makes one of the whole table.  Rows
    that are equal in key and order come in any order, which is fixed once; they are in one
    range, so an order that many rows share should go on with something that tells them apart.
    Tasks is the number of ranges, by default that of shuffle partitions.
    """
    values = {s: F.coalesce(v, F.lit(0)) for s, v in sums.items()}

    def within(ordered: Window, whole: Window) -> list[Column]:
        so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
        return [F.sum(v).over(so_far).alias(s) for s, v in values.items()] + [F.sum(v).over(whole).alias(f"_all_{s}") for s, v in values.items()]

    earlier = Window.partitionBy("who").orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    joined = carried(frame, key, order, list(sums), within, lambda s: F.sum(s).over(earlier), tasks)
    return joined.select(*frame.columns, *((F.col(s) + F.coalesce(f"_all_{s}", F.lit(0))).alias(s) for s in sums))


def previous(frame: DataFrame, key: list[str], order: list[Column | str], values: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """frame with what its key's row before held, null for the first; keys, ties and tasks as for running. Values can be put in order."""
    def within(ordered: Window, whole: Window) -> list[Column]:
        every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.row_number().over(ordered) == 1
        return [F.lag(v).over(ordered).alias(n) for n, v in values.items()] + [F.last(v).over(every).alias(f"_all_{n}") for n, v in values.items()] + [first.alias(FIRST)]

    before = Window.partitionBy("who").orderBy(SPLIT)
    joined = carried(frame, key, order, list(values), within, lambda n: F.lag(n).over(before), tasks)
    return joined.select(*frame.columns, *(F.when(F.col(FIRST), F.col(f"_all_{n}")).otherwise(F.col(n)).alias(n) for n in values))


def carried(frame: DataFrame, key: list[str], order: list[Column | str], names: list[str], within: Callable, across: Callable[[str], Column], tasks: int | None) -> DataFrame:
    """frame with what `within` finds in ranges, and, as _all_ names, what `across` makes of the ranges before that hold a row's key."""
    n = tasks or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(n, *map(F.col, key), *map(column, order)).withColumn(SPLIT, F.spark_partition_id())
    whole = Window.partitionBy(SPLIT, *key)
    who = F.struct(*key) if key else F.struct(F.lit(0).alias("all"))  # structs of nulls are equal
    local = store(dealt.select("*", *within(whole.orderBy(*map(column, order)), whole)), "ranges")
    end = F.struct(who.alias("who"), *(F.col(f"_all_{s}").alias(s) for s in names))
    ends = local.groupBy(SPLIT).agg(F.min(end).alias("least"), F.max(end).alias("most"))
    totals = ends.select(SPLIT, F.explode(F.array_distinct(F.array("least", "most"))).alias("end")).select(SPLIT, "end.*")
    is_later = F.row_number().over(Window.partitionBy("who").orderBy(SPLIT)) > 1
    handed = totals.select(SPLIT, F.col("who").alias(WHO), *(across(s).alias(f"_all_{s}") for s in names), is_later.alias("_later"))
    handed = F.broadcast(handed.where("_later").drop("_later"))  # a range goes on with one key at most
    return local.drop(*(f"_all_{s}" for s in names)).withColumn(WHO, who).join(handed, [SPLIT, WHO], "left")
