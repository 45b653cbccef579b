"""Joins with keys that very many rows ask for, and what is connected with what."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import store

MOST_HOT = 10_000  # rows of a broadcast list
LEAST_HOT = 1000  # that many askers one task can serve


def often_asked(n: str, total: int) -> Column:
    """Whether a key that n of all the askers ask for is a hot one; there are no more than MOST_HOT of them."""
    return F.col(n) > max(LEAST_HOT, total // MOST_HOT)


def look_up(left: DataFrame, right: DataFrame, key: list[str], often: Column) -> DataFrame:
    """left with right's columns, null where there are none.

    right has a key once; its rows that are often asked for, at most MOST_HOT, are broadcast,
    so that their askers stay where they are.
    """
    hot, seldom = F.broadcast(right.where(often)), right.where(~often)
    return left.join(hot, key).unionByName(left.join(hot.select(*key), key, "left_anti").join(seldom, key, "left"))


def roots(pointers: DataFrame) -> DataFrame:
    """node and root of a forest of rows node, up (a root's up is itself); each round doubles the reach, so they are few."""
    table = store(pointers, "pointers")
    total = table.count()
    while True:
        asked = table.groupBy("up").agg(F.count("*").alias("n"))
        above = table.select(F.col("node").alias("up"), F.col("up").alias("next")).join(asked, "up")
        moved = look_up(table, above, ["up"], often_asked("n", total))
        moved = store(moved.select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")), "pointers")
        table = moved.select("node", "up")
        if moved.where("moved").isEmpty():
            return table.withColumnRenamed("up", "root")


def contracted(links: DataFrame, at_once: int = 1 << 20) -> DataFrame:
    """Links with the same components, of each node to the least one it is connected with, within so many links of a task at once."""

    def least(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        root = np.arange(len(nodes))
        while (root[x] != root[y]).any():
            u, v = root[x], root[y]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (root != root[root]).any():
                root = root[root]
        return pa.record_batch([pa.array(nodes), pa.array(nodes[root])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= at_once:
                yield least(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield least(*map(np.concatenate, zip(*held)))

    return links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node and root, its component's least node, of links (a, b) between whole numbers, by alternating large and small stars.

    Links are contracted first where they are read, so that rounds go over nodes rather than links.
    """
    downward = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = store(contracted(links), "links")
    edges = links.where("a <> b").select(*downward)
    total = 2 * edges.count()  # a star has no more links than it is made of

    def star(near: DataFrame, large: bool) -> DataFrame:
        """The links of near (a to its neighbours b), each to a's least neighbour, or a itself, instead of to a."""
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
        turned = look_up(near.where("b > a") if large else near, least, ["a"], often_asked("n", total)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = turned if large else turned.unionByName(least.select("a", F.col("m").alias("b")))
        return kept.where("a <> b").select(*downward).distinct()

    before, now = None, 0
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = store(star(star(both, True), False), "stars")
        before, now = now, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first()
    rest = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(rest.withColumn("root", F.col("node")))
