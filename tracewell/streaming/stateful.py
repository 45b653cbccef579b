"""What a growing log needs state for: one-to-one pairs of two sources, and blocks of lines.

Both need a session whose state is kept by RocksDB (`state_store`).  A key's state is in one
task: of pairs, the events that the watermark or the tolerance still holds open; of blocks, the
open block.  So a key's events should fit into one task's time, though not into its memory.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.pairing import PLACES

EVENT = "t bigint, side int, id bigint"


def state_store(spark: SparkSession) -> None:
    """State by RocksDB, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Pairs(StatefulProcessor):
    """Events wait until the watermark has passed them and are then walked in order of time, as pairing.pair does."""

    def __init__(self, key: list[str], tolerance: int):
        self.key, self.tolerance = key, tolerance

    def init(self, handle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", EVENT)  # not yet passed by the watermark
        self.queue = handle.getListState("queue", EVENT)  # walked, and waiting for the other side

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(s), int(i)) for part in rows for t, s, i in zip(part["t"], part["side"], part["id"])]
        self.ahead.appendList(new)
        self.wake(min(new)[0])
        yield self.told(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ahead = sorted(tuple(x) for x in self.ahead.get())
        queue, out = deque(tuple(x) for x in self.queue.get()), []
        n = sum(x[0] <= passed for x in ahead)
        for t, side, own in ahead[:n]:
            while queue and t - queue[0][0] > self.tolerance:
                out.append(lone(*queue.popleft()))
            if queue and queue[0][1] != side:
                s, other, x = queue.popleft()
                out.append((x, own, s, t) if other == 0 else (own, x, t, s))
            else:
                queue.append((t, side, own))
        while queue and passed - queue[0][0] >= self.tolerance:  # all that is to come is later
            out.append(lone(*queue.popleft()))
        for state, rows in ((self.ahead, ahead[n:]), (self.queue, list(queue))):
            if rows:
                state.put(rows)
            else:
                state.clear()
        nexts = [x[0] for x in ahead[n : n + 1]] + [x[0] + self.tolerance for x in list(queue)[:1]]
        if nexts:
            self.wake(min(nexts))
        yield self.told(key, out)

    def wake(self, t: int) -> None:
        self.handle.registerTimer(-(-t // 1000))

    def told(self, key, rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=PLACES).astype("Int64")
        for k, v in reversed(list(zip(self.key, key))):
            frame.insert(0, k, pd.Series([v] * len(rows), dtype=object))
        return frame

    def close(self) -> None:
        pass


def lone(t: int, side: int, own: int) -> tuple:
    return (own, None, t, None) if side == 0 else (None, own, None, t)


def pair(a: DataFrame, b: DataFrame, key: list[str], tolerance: int, delay: str = "10 seconds") -> DataFrame:
    """key, a_id, b_id, a_t and b_t of two streams: what pairing.pair finds in all that has come, as the watermark passes it.

    Both have the key, time (a timestamp) and id, and may come in any order that the delay
    allows; times are told in microseconds, as is the tolerance.  Rows behind the watermark are
    dropped, and counted in the query's progress; so are rows without a time, which no
    watermark passes.  An event that stays alone is told when the watermark is a tolerance
    beyond it.  The result is appended to.
    """
    def of(frame: DataFrame, side: int) -> DataFrame:
        return frame.select(*key, "time", F.unix_micros("time").alias("t"), F.lit(side).alias("side"), F.col("id").cast("bigint").alias("id"))

    events = of(a, 0).unionByName(of(b, 1)).where("time is not null").withWatermark("time", delay)
    kinds = dict(events.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"{c} bigint" for c in PLACES)])
    return events.groupBy(*key).transformWithStateInPandas(Pairs(key, tolerance), schema, "Append", "EventTime")


class Blocks(StatefulProcessor):
    """The open block of a file; a header ends the one before it, and so does silence."""

    def __init__(self, header: str, drop: str | None, silence: float):
        self.header, self.drop, self.silence = header, drop, silence

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "block bigint, line bigint, head string, told boolean")  # line: of the block's first line that is not yet told of
        self.body = handle.getListState("body", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values("nr", kind="stable")
        header, drop = re.compile(self.header), re.compile(self.drop) if self.drop else None
        block, line, head, told = self.open.get() or (-1, 0, None, True)
        body = [x[0] for x in self.body.get()] if self.open.exists() else []
        out = []
        for nr, value in zip(lines["nr"], lines["value"]):
            if not value or (drop and drop.search(value)):
                continue
            if header.search(value):
                if block >= 0 and not (told and not body):
                    out.append((block, line, head, body, not told))
                block, line, head, body, told = block + 1, int(nr), value, [], False
            elif block >= 0:
                line = int(nr) if told and not body else line
                body.append(value)
        if block >= 0:
            self.open.update((block, line, head, told))
            if body:
                self.body.put([(x,) for x in body])
            else:
                self.body.clear()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.silence * 1000))
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block, line, head, told = self.open.get()
        body = [x[0] for x in self.body.get()]
        out = [] if told and not body else [(block, line, head, body, not told)]
        self.open.update((block, line, head, True))
        self.body.clear()
        yield self.frame(key, out)

    @staticmethod
    def frame(key, rows: list) -> pd.DataFrame:
        out = [(key[0], block, line, head if first else None, body, len(body) + int(first)) for block, line, head, body, first in rows]
        return pd.DataFrame(out, columns=["file", "block", "line", "head", "body", "n_lines"])

    def close(self) -> None:
        pass


def blocks(lines: DataFrame, header: str, drop: str | None = None, silence: float = 30.0) -> DataFrame:
    """file, block (from 0), line, head, body and n_lines of the blocks of growing files, as logs.blocks finds them in whole ones.

    lines has file, nr (a line's number in its file) and value; a file's lines come in order,
    in batches cut anywhere.  A block is told when the next header comes, or after so many
    seconds of silence; lines that come to it later are told as a further row of its number,
    without head.  Line is the number of a row's first line.  Lines before the first header,
    empty ones, and those that match drop, are left out.
    """
    schema = "file string, block bigint, line bigint, head string, body array<string>, n_lines bigint"
    return lines.select("file", "nr", "value").groupBy("file").transformWithStateInPandas(Blocks(header, drop, silence), schema, "Append", "ProcessingTime")
