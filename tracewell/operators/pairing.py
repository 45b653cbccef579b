"""One-to-one pairing of two event sources within a tolerance, and what becomes of each event.

Per key, both sides are walked in time order: if the two next events are no more than the
tolerance apart they are a pair, else the earlier one stays alone.  So the walk carries a
queue of events of one side, none older than the tolerance, and these are always the last
ones of that side: a number m, above zero for the first side and below for the second, tells
all.  An event bounds m by how many of either side are recent enough, and moves it by one.

A key's time is cut into chunks many tolerances wide, so that a key with a third of all
events is spread over its chunks.  Each chunk also gets the events that may wait at its
start.  What it makes of any m is m + shift, bounded from both sides: three numbers, which
two walks find, from all and from none of either side that may wait.  Such functions are
composed in a tree over a key's chunks; then it is known with what m each chunk begins, and
each is walked once more, for its pairs.  There are no rounds: the work does not depend on
how far an odd event makes itself felt.

An event without a time comes after all of its side that have one.  Once one side's times
are used up, what is left of both sides is paired by position as long as one of the two has
no time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import store
from .joins import look_up, often_asked
from .scans import running

CHUNK = 64  # tolerances in a chunk
FAN, LEVELS = 256, 2  # of the tree over a key's chunks
PLACES = ["a_id", "b_id", "a_t", "b_t"]


def pair(a: DataFrame, b: DataFrame, key: list[str], tolerance: int, chunk: int = CHUNK) -> DataFrame:
    """key, a_id, b_id, a_t and b_t: pairs, and rows with one side null for events that stay alone.

    Both sides have the key, t and id (integers).  Keys that are null are a key like others.
    Events of a side with equal times go by their id, as do those without a time.
    """
    events = a.select(*key, "t", F.lit(0).alias("side"), "id").unionByName(b.select(*key, "t", F.lit(1).alias("side"), "id"))
    pairs = walked(events.where("t is not null"), key, tolerance, max(tolerance, 1) * chunk)
    none = events.where("t is null")
    if none.isEmpty():
        return pairs
    who = F.struct(*key).alias("who")  # structs of nulls are equal
    keys = none.select(who).distinct()
    lone = [F.when(F.col("side") == k, F.col("id")).alias(n) for k, n in enumerate(PLACES[:2])] + [F.lit(None).cast("bigint").alias(n) for n in PLACES[2:]]
    known = store(pairs.withColumn("who", who), "pairs")
    some = known.join(keys, "who", "left_semi").drop("who").unionByName(none.select(*key, *lone))
    return known.join(keys, "who", "left_anti").drop("who").unionByName(untimed(some, key, tolerance))


def walked(events: DataFrame, key: list[str], tolerance: int, width: int) -> DataFrame:
    """Pairs and lone events of events that have a time."""
    width = max(width, 2 * tolerance)  # what waits at a chunk's end is settled in the next
    chunk = F.floor(F.col("t") / width)
    chunks = F.when(F.col("t") >= (chunk + 1) * width - tolerance, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = events.select(F.struct(*key).alias("who"), F.col("t").cast("bigint").alias("t"), "side", F.col("id").cast("bigint").alias("id"))
    dealt = rows.select("who", F.explode(chunks).alias("chunk"), "t", "side", "id")
    begin = starts(store(transfers(dealt, tolerance, width), "transfers"))
    return walk(dealt.join(begin, ["who", "chunk"]), tolerance, width).select("who.*", *PLACES)


def transfers(events: DataFrame, tolerance: int, width: int) -> DataFrame:
    """who, chunk and shift, low and high: a chunk that begins with m ends with m + shift, but at least low and at most high."""
    dealt = sorted_chunks(events.select("who", "chunk", "t", "side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[deque, deque] = deque(), deque()  # of times, by side
        ends: list = []  # m and queue of the walks
        shift, heads, off = 0, None, 0

        def close() -> tuple[int, int, int]:
            return shift, *sorted((at(ends[0]), at(ends[-1])) if ends else (-len(waiting[1]), len(waiting[0])))

        def at(end: list) -> int:
            return len(end[1]) if end[0] == 0 else -len(end[1])

        for heads, off, early, batch in in_chunks(batches, width):
            out = []
            for i, (begins, waits, t, side) in enumerate(zip(*early, *(batch.column(n).to_pylist() for n in ("t", "side")))):
                if begins:
                    if i + off:
                        out.append((i + off - 1, *close()))
                    waiting, ends, shift = (deque(), deque()), [], 0
                if waits:
                    waiting[side].append(t)
                    continue
                ends = ends or [[1, waiting[1]], [0, waiting[0]]]
                shift += 1 if side == 0 else -1
                for end in ends:
                    queue = end[1]
                    while queue and t - queue[0] > tolerance:
                        queue.popleft()
                    if queue and end[0] != side:
                        queue.popleft()
                    else:
                        end[0] = side
                        queue.append(t)
                if len(ends) == 2 and at(ends[0]) == at(ends[1]):
                    ends.pop()  # from here on the start makes no difference
            yield told(heads, out)
        if heads is not None:
            yield told(heads, [(len(heads[1]) - 1, *close())])

    def told(heads: tuple, rows: list) -> pa.RecordBatch:
        where, *values = zip(*rows) if rows else [()] * 4
        return pa.record_batch([*(h.take(pa.array(where, pa.int64())) for h in heads), *(pa.array(v, pa.int64()) for v in values)], ["who", "chunk", "shift", "low", "high"])

    return dealt.mapInArrow(run, f"who {dict(events.dtypes)['who']}, chunk bigint, shift bigint, low bigint, high bigint")


def after(m: Column, f: Column) -> Column:
    return F.greatest(F.least(m + f["shift"], f["high"]), f["low"])


def starts(chunks: DataFrame) -> DataFrame:
    """who, chunk and m, with which each chunk begins: composed upwards in a tree of FAN, and handed down."""
    levels, f = [], ["shift", "low", "high"]
    for level in range(LEVELS + 1):
        group = ["who", *([F.floor(F.col("chunk") / FAN).alias("parent")] if level < LEVELS else [])]
        parts = chunks.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("chunk", *f))).alias("parts"))
        levels.append(parts)
        none = F.struct(*(F.lit(v).cast("bigint").alias(n) for n, v in zip(f, (0, -(2**62), 2**62))))
        whole = F.aggregate("parts", none, lambda x, p: F.struct((x["shift"] + p["shift"]).alias("shift"), after(x["low"], p).alias("low"), after(x["high"], p).alias("high")))
        if level < LEVELS:
            chunks = parts.select("who", F.col("parent").alias("chunk"), whole.alias("f")).select("who", "chunk", "f.*")
    state = levels[-1].withColumn("m", F.lit(0).cast("bigint"))
    for level in range(LEVELS, -1, -1):
        first = F.struct(F.col("m").alias("m"), F.array().cast("array<bigint>").alias("all"))
        every = F.aggregate("parts", first, lambda x, p: F.struct(after(x["m"], p).alias("m"), F.concat(x["all"], F.array(x["m"])).alias("all")))["all"]
        state = state.select("who", F.explode(F.arrays_zip(F.col("parts.chunk").alias("chunk"), every.alias("m"))).alias("x")).select("who", "x.*")
        if level:
            state = state.withColumnRenamed("chunk", "parent").join(levels[level - 1], ["who", "parent"])
    return state


def sorted_chunks(events: DataFrame) -> DataFrame:
    order = ["who", "chunk", "t", "side", *(["id"] if "id" in events.columns else [])]
    return events.repartition("who", "chunk").sortWithinPartitions(*order)


def in_chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Batches with their keys and chunks, those of the row before in front; how many those are; and which rows begin a chunk, and which come from before it."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = batch.column("who"), batch.column("chunk")
        if last is not None:
            heads = tuple(pa.concat_arrays([x, y]) for x, y in zip(last, heads))
        off = len(heads[1]) - batch.num_rows
        new = np.concatenate([[True], changes(*heads)])[off:]
        early = batch.column("t").to_numpy() < batch.column("chunk").to_numpy() * width
        yield heads, off, (new.tolist(), early.tolist()), batch
        last = tuple(h.slice(len(h) - 1) for h in heads)


def walk(events: DataFrame, tolerance: int, width: int) -> DataFrame:
    """who and the pair's or lone event's ids and times; an event that waits at a chunk's end is told of by the next chunk."""
    dealt = sorted_chunks(events.select("who", "chunk", "t", "side", "id", "m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[list, list] = [], []
        queue: deque | None = None  # (t, side, id)
        heads, start = None, 0

        def begun() -> deque:
            own = waiting[0] if start > 0 else waiting[1]
            return deque(own[len(own) - min(abs(start), len(own)) :])

        def lone(where: int, t: int, side: int, own: int) -> tuple:
            return (where, own, None, t, None) if side == 0 else (where, None, own, None, t)

        def end(where: int) -> list:
            edge = (heads[1][where].as_py() + 1) * width - tolerance
            return [lone(where, *e) for e in (begun() if queue is None else queue) if e[0] < edge]

        for heads, off, early, batch in in_chunks(batches, width):
            rows: list = []
            for i, (begins, waits, t, side, own, m) in enumerate(zip(*early, *(batch.column(n).to_pylist() for n in ("t", "side", "id", "m"))), off):
                if begins:
                    if i:
                        rows += end(i - 1)
                    waiting, queue, start = ([], []), None, m
                if waits:
                    waiting[side].append((t, side, own))
                    continue
                queue = begun() if queue is None else queue
                while queue and t - queue[0][0] > tolerance:
                    rows.append(lone(i, *queue.popleft()))
                if queue and queue[0][1] != side:
                    s, other, x = queue.popleft()
                    rows.append((i, x, own, s, t) if other == 0 else (i, own, x, t, s))
                else:
                    queue.append((t, side, own))
            yield table(heads[0], rows)
        if heads is not None:
            yield table(heads[0], end(len(heads[1]) - 1))

    def table(who: pa.StructArray, rows: list) -> pa.RecordBatch:
        where, *values = zip(*rows) if rows else [()] * 5
        return pa.record_batch([who.take(pa.array(where, pa.int64())), *(pa.array(v, pa.int64()) for v in values)], ["who", *PLACES])

    return dealt.mapInArrow(run, f"who {dict(events.dtypes)['who']}, a_id bigint, b_id bigint, a_t bigint, b_t bigint")


def changes(who: pa.StructArray, chunk: pa.Array) -> np.ndarray:
    """Whether each row but the first has another key or chunk than the one before it."""
    out = np.diff(chunk.to_numpy()) != 0
    for column in who.flatten():
        x, y = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.fill_null(pc.equal(x, y), False)
        both = pc.and_(pc.is_null(x), pc.is_null(y))
        out |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return out


def untimed(pairs: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """Pairs, where events without a time stand alone, with those paired by position with what the walk in time left over.

    The walk ends when one side's times are used up; what it has not reached of the other
    side is all that lies no more than the tolerance before that side's last time.
    """
    has_a, has_b = F.col("a_id").isNotNull(), F.col("b_id").isNotNull()
    lone_a, lone_b = has_a & ~has_b, has_b & ~has_a
    some = store(pairs.withColumn("who", F.struct(*key)), "untimed")
    is_open = F.bool_or((has_a & F.col("a_t").isNull()) | (has_b & F.col("b_t").isNull()))
    lasts = some.groupBy("who").agg(F.max("a_t").alias("last_a"), F.max("b_t").alias("last_b"), is_open.alias("open"), F.count("*").alias("n"))
    known = look_up(some, lasts, ["who"], often_asked("n", some.count()))

    def reached_not(lone: Column, t: Column, last: Column) -> Column:
        return lone & (t.isNull() | last.isNull() | (t >= last - tolerance))

    rest = F.col("open") & (reached_not(lone_a, F.col("a_t"), F.col("last_b")) | reached_not(lone_b, F.col("b_t"), F.col("last_a")))
    left = known.where(rest).select(*key, *PLACES, F.when(lone_a, 0).otherwise(1).alias("side"))
    placed = running(left, [*key, "side"], [F.coalesce("a_t", "b_t").asc_nulls_last(), F.coalesce("a_id", "b_id")], {"place": F.lit(1)})
    paired = placed.groupBy(F.struct(*key).alias("who"), "place").agg(*(F.max(c).alias(c) for c in PLACES))
    return known.where(~rest).select(*key, *PLACES).unionByName(paired.select("who.*", *PLACES))


def near(alone: DataFrame, others: DataFrame, key: list[str], tolerance: int) -> DataFrame:
    """Events with t and id, and whether the other source has one of their key within the tolerance.

    Times are dealt into buckets as wide as the tolerance; an event looks into three of them.
    """
    width = max(tolerance, 1)
    one = alone.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("t") / width) + k for k in (-1, 0, 1)))))
    spans = others.groupBy(*key, F.floor(F.col("t") / width).alias("bucket")).agg(F.array_sort(F.collect_set("t")).alias("times"))
    joined = one.join(spans, [*key, "bucket"], "left")
    hit = F.exists("times", lambda x: F.abs(x - F.col("t")) <= tolerance)
    return joined.groupBy(*key, "t", "id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("near"))


def classify(up: Column, a: Column, b: Column, bad: Column, silent: Column, close: Column) -> Column:
    """What became of an event: a and b tell which side has it; close whether a is near a lone b."""
    uplink = (
        F.when(a & b, F.when(bad, "rx-ko/ue-tx").otherwise("rx-ok"))
        .when(a, F.when(~bad, "ue-missing").when(silent, "rx-ko/ue-silent").otherwise("rx-ko/ue-missing"))
        .otherwise(F.when(close, "ue-extra-tx/contention").otherwise("gnb-missing"))
    )
    downlink = F.when(a & b, "tx-rx-ok").when(a, "ue-missing-rx").otherwise("gnb-missing-tx")
    return F.when(up, uplink).otherwise(downlink)


#: Fixed values.
ANOMALIES = ("rx-ko/ue-tx", "rx-ko/ue-silent", "rx-ko/ue-missing", "gnb-missing", "ue-missing-rx")
