"""Counters, states and timelines of events by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import previous, running


def counters(frame: DataFrame, key: list[str], tests: dict[str, Column]) -> DataFrame:
    """How many rows meet each test, in one pass."""
    return frame.groupBy(*key).agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))


def span(frame: DataFrame, key: list[str], at: str) -> DataFrame:
    return frame.groupBy(*key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), (F.max(at) - F.min(at)).alias("duration"))


def changes(frame: DataFrame, key: list[str], state: str, order: list[str]) -> DataFrame:
    """Rows whose state differs from the one before, by key; the first is a change."""
    held = previous(frame, key, order, {"before": F.col(state), "is_later": F.lit(True)})
    return held.where(F.col("is_later").isNull() | ~F.col("before").eqNullSafe(F.col(state))).drop("is_later")


def final_states(frame: DataFrame, key: list[str], state: str, order: str) -> DataFrame:
    return frame.groupBy(*key).agg(F.max_by(state, order).alias("final"), F.min(order).alias("seen"))


def breakdown(finals: DataFrame) -> DataFrame:
    """Entities by final state, the commonest first, ties by who was seen first."""
    return finals.groupBy("final").agg(F.count("*").alias("n"), F.min("seen").alias("seen")).orderBy(F.desc("n"), "seen")


def never(frame: DataFrame, key: list[str], reached: Column) -> DataFrame:
    """Keys none of whose rows meets a condition."""
    return frame.groupBy(*key).agg(F.bool_or(F.coalesce(reached, F.lit(False))).alias("was")).where("not was").drop("was")


def common(frame: DataFrame, key: list[str], label: str, order: str, top: int) -> DataFrame:
    """The commonest labels of each key, ties by first appearance."""
    held = frame.groupBy(*key, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "seen"))
    return held.withColumn("nth", nth).where(F.col("nth") <= top)


def distinct_ids(frame: DataFrame, label: str, value: str) -> DataFrame:
    """Distinct values of each label, in order; their number must be small enough for a row."""
    return frame.where(F.col(value).isNotNull()).groupBy(label).agg(F.array_sort(F.collect_set(value)).alias("ids"))


def merged(parts: dict[str, DataFrame], low: int | None = None, high: int | None = None) -> DataFrame:
    """One timeline of several sources with columns t and id, for [low, high); order by t, rank and id."""
    out = None
    for rank, (name, part) in enumerate(parts.items()):
        if low is not None:
            part = part.where(F.col("t") >= low)
        if high is not None:
            part = part.where(F.col("t") < high)
        part = part.select("t", F.lit(name).alias("src"), F.lit(rank).alias("rank"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def disjoint(timeline: DataFrame) -> DataFrame:
    """First and last of each source, and whether the sources have no time in common."""
    spans = timeline.groupBy("src").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    whole = spans.agg((F.max("first") > F.min("last")).alias("disjoint"))
    return spans.crossJoin(F.broadcast(whole))  # one row


def run_lengths(frame: DataFrame, key: list[str], test: Column, order: list[str]) -> DataFrame:
    """Runs of rows that meet a test, one after the other, by key: their length and first row's order."""
    marked = running(frame.withColumn("hit", F.coalesce(test, F.lit(False))), key, order, {"run": (~F.col("hit")).cast("bigint")})
    return marked.where("hit").groupBy(*key, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("start")).drop("run")


def epochs(frame: DataFrame, key: list[str], release: Column, order: list[str]) -> DataFrame:
    """Rows with the number of the life that they belong to; a release ends a life and belongs to it."""
    ended = F.coalesce(release, F.lit(False)).cast("bigint")
    return running(frame, key, order, {"epoch": ended}).withColumn("epoch", F.col("epoch") - ended)


def steps(frame: DataFrame, key: list[str], label: str, order: str, expected: list, chunk: int = 100_000) -> DataFrame:
    """How far each key came in an expected sequence: steps reached in order, the last one and the first that is missing.

    A step counts at its first row after the step before it; order is a whole number.  A
    chunk of a key's rows tells where one ends up from each step, and only that is put
    together for the key, so a key with many rows is walked in many tasks.
    """
    sequence = F.array(*map(F.lit, expected))
    row = F.when(F.col(label).isin(*expected), F.struct(F.col(order), F.col(label)))
    parts = frame.groupBy(*key, F.floor(F.col(order) / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def onward(start: Column) -> Column:
        return F.aggregate("rows", start, lambda k, r: F.when(F.get(sequence, k).eqNullSafe(r[label]), k + 1).otherwise(k))

    walked = parts.select(*key, "chunk", F.transform(F.sequence(F.lit(0), F.lit(len(expected))), onward).alias("to"))
    whole = walked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", "to"))).alias("chunks"))
    reached = F.aggregate("chunks", F.lit(0), lambda k, c: F.get(c["to"], k))
    return whole.select(*key, reached.alias("reached")).select(*key, "reached", F.get(sequence, F.col("reached") - 1).alias("last_step"), F.get(sequence, F.col("reached")).alias("missing"))


def before_events(frame: DataFrame, key: list[str], event: Column, span: int, label: str, order: str) -> DataFrame:
    """For each event the rows of its key in the span before it, itself excluded: how many, and the last one's label.

    frame has t; rows at the event's own time count if they come before it in order.
    """
    w = Window.partitionBy(*key).orderBy("t").rangeBetween(-span, 0)
    at = Window.partitionBy(*key, "t").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    last = F.lag(label).over(Window.partitionBy(*key).orderBy("t", order))
    held = frame.withColumn("n_before", F.count("*").over(w) - F.count("*").over(at)).withColumn("last_before", F.when(F.col("n_before") > 0, last))
    return held.where(event)


def loops(frame: DataFrame, key: list[str], start: Column, order: list[str]) -> DataFrame:
    """Rows with the number of the loop that they belong to, from 1; rows before the first start are of loop 0."""
    return running(frame, key, order, {"loop": F.coalesce(start, F.lit(False)).cast("bigint")})


def moves(frame: DataFrame, key: list[str], begin: Column, end: Column, place: str, order: str) -> DataFrame:
    """Begun moves whose next row that ends one is in another place: key, order, place and place_after."""
    begun = F.coalesce(begin, F.lit(False))
    held = frame.withColumn("_begin", begun).where(F.col("_begin") | F.coalesce(end, F.lit(False)))
    after = previous(held, key, [F.col(order).desc()], {"_next_begins": F.col("_begin"), "place_after": F.col(place)})
    return after.where(F.col("_begin") & ~F.col("_next_begins") & F.col("place_after").isNotNull() & (F.col("place_after") != F.col(place))).select(*key, order, place, "place_after")


def bins(frame: DataFrame, key: list[str], histogram: str, order: str) -> DataFrame:
    """Sums of a histogram's bins, and by how much each bin grew from the first to the last record."""
    long = frame.select(*key, order, F.posexplode(histogram).alias("bin", "n"))
    return long.groupBy(*key, "bin").agg(F.sum("n").alias("total"), (F.max_by("n", order) - F.min_by("n", order)).alias("growth"))


def in_order_of_appearance(frame: DataFrame, key: list[str], label: str, order: str) -> DataFrame:
    """Distinct labels of each key, numbered as they first appear."""
    first = frame.where(F.col(label).isNotNull()).groupBy(*key, label).agg(F.min(order).alias("seen"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("seen")))
