"""Procedures in captures: overviews, balances, and links between protocols by time and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import look_up, often_asked
from .scans import previous, running


def overview(frame: DataFrame, key: list[str], failed: Column) -> DataFrame:
    """Packets, first and last time, duration and failures of each capture."""
    return frame.groupBy(*key).agg(F.count("*").alias("packets"), F.min("t").alias("first"), F.max("t").alias("last"), (F.max("t") - F.min("t")).alias("duration"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures"))


def unsuccessful(outcome: Column) -> Column:
    """Whether a message is an unsuccessful outcome: what an overview counts."""
    return F.coalesce(outcome == "unsuccessfulOutcome", F.lit(False))


def unsuccessful_or_caused(outcome: Column, cause: Column) -> Column:
    """Whether a message is an unsuccessful outcome or gives a cause: what a list of procedures marks."""
    return unsuccessful(outcome) | cause.isNotNull()


def ids_by_label(frame: DataFrame, key: list[str], labels: list[str]) -> DataFrame:
    """How many different ids each label has, labels kept apart: one row for a key and label."""
    long = frame.select(*key, F.inline(F.array(*(F.struct(F.lit(n).alias("label"), F.col(n).cast("string").alias("id")) for n in labels)))).where("id is not null")
    return long.groupBy(*key, "label").agg(F.count_distinct("id").alias("ids"))


def per_entity(frame: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """Rows of entities numbered in order, with how many there are; rows without an entity go."""
    known = frame.where(F.coalesce(*(F.col(e).cast("string") for e in entity)).isNotNull()).withColumn("_who", F.struct(*entity))
    counts = known.groupBy("_who").agg(F.count("*").alias("of"))
    numbered = running(known, entity, order, {"nth": F.lit(1)})
    return look_up(numbered, counts, ["_who"], often_asked("of", counts.agg(F.sum("of")).first()[0] or 0)).drop("_who")


def balance(frame: DataFrame, key: list[str], begun: Column, ended: Column) -> DataFrame:
    """How many procedures begin and end in each key, and whether the numbers differ."""
    counted = frame.groupBy(*key).agg(F.count_if(F.coalesce(begun, F.lit(False))).alias("begun"), F.count_if(F.coalesce(ended, F.lit(False))).alias("ended"))
    return counted.withColumn("unbalanced", F.col("begun") != F.col("ended"))


def storms(frame: DataFrame, key: list[str], test: Column, least: int) -> DataFrame:
    """Keys, such as an entity, a bearer and a sequence number, with at least so many rows that meet a test."""
    return frame.where(test).groupBy(*key).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).where(F.col("n") >= least)


def nearest(left: DataFrame, right: DataFrame, key: list[str], after: int, before: int = 0) -> DataFrame:
    """For each left event the right one nearest to it, from before it to after it, both included; the earlier of equally near ones, then the least id.

    Both have the key, t and id, and left events without a match have nulls.  Time is dealt
    into buckets as wide as what an event looks at, and right events are also put into the
    buckets beside theirs.  A bucket's events are walked in order of time and carry along the
    last right event before them and the first one after them: no event meets all others of
    its key, and a key with many events is spread over its buckets.
    """
    width = max(after + before, 1)
    bucket = F.floor(F.col("t") / width)
    beside = right.where("t is not null").select(*key, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"), "t", F.lit(0).alias("side"), "id")
    both = left.select(*key, bucket.alias("bucket"), "t", F.lit(1).alias("side"), "id").unionByName(beside)
    own = F.when(F.col("side") == 0, F.struct("t", "id"))
    w = Window.partitionBy(*key, "bucket")
    so_far = (Window.unboundedPreceding, 0)
    back = w.orderBy("t", "side", F.desc("id")).rowsBetween(*so_far)
    ahead = w.orderBy(F.desc("t"), "side", F.desc("id")).rowsBetween(*so_far)
    walked = both.withColumn("was", F.last(own, ignorenulls=True).over(back)).withColumn("will", F.last(own, ignorenulls=True).over(ahead)).where("side = 1")
    t = F.col("t")
    was, will = F.when(t - F.col("was.t") <= before, F.col("was")), F.when(F.col("will.t") - t <= after, F.col("will"))
    best = F.when(was.isNull(), will).when(will.isNull(), was).when(t - was["t"] <= will["t"] - t, was).otherwise(will)
    chosen = walked.withColumn("best", best)
    return chosen.select(*key, "t", "id", F.col("best.t").alias("other_t"), F.col("best.id").alias("other_id"))


def identity_chain(first: DataFrame, *links: DataFrame) -> DataFrame:
    """Distinct identities followed through tables of pairs, each with one column in common with what came before; unknown ones are null.

    A pair table that gives one identity several others yields a row for each.
    """
    out = first.distinct()
    for link in links:
        shared = [c for c in link.columns if c in out.columns]
        out = out.join(link.distinct(), shared, "left")
    return out


def without_answer(frame: DataFrame, key: list[str], order: str, request: Column, answers: Column) -> DataFrame:
    """Requests of a key that no answer follows before the next request."""
    asked, answered = F.coalesce(request, F.lit(False)), F.coalesce(answers, F.lit(False))
    held = frame.withColumn("asked", asked).where(asked | answered)
    following = previous(held, key, [F.col(order).desc()], {"answered": ~F.col("asked")})
    return following.where(F.col("asked") & ~F.coalesce("answered", F.lit(False))).drop("asked", "answered")


def reconcile(counts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """The counts (key, n) of several sources side by side, 0 where a source has none, and whether they agree."""
    rows = None
    for name, c in counts.items():
        part = c.select(*key, F.lit(name).alias("source"), F.col("n").cast("bigint").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    wide = rows.groupBy(*key).pivot("source", list(counts)).agg(F.sum("n")).na.fill(0, list(counts))
    return wide.withColumn("agree", F.greatest(*counts) == F.least(*counts) if len(counts) > 1 else F.lit(True))


def random_access(preambles: DataFrame, answers: DataFrame, thirds: DataFrame, key: list[str], within: int) -> DataFrame:
    """Preambles (key, t, id) with the answer that comes next and its temporary identity, and the third message that then uses it.

    answers and thirds have rnti besides; each link is the nearest one not later than `within`
    after what it follows.  A side's preamble numbers mean nothing to the other, so the
    temporary identity is what joins them.  Missing links are null.
    """
    first = nearest(preambles, answers, key, within).select(*key, "t", "id", F.col("other_t").alias("answer_t"), F.col("other_id").alias("answer_id"))
    known = first.join(answers.select(*key, F.col("t").alias("answer_t"), F.col("id").alias("answer_id"), "rnti"), [*key, "answer_t", "answer_id"], "left")
    by = [*key, "rnti"]
    asked = known.where("rnti is not null").select(*by, F.col("answer_t").alias("t"), F.col("answer_id").alias("id")).distinct()
    last = nearest(asked, thirds, by, within).select(*by, F.col("t").alias("answer_t"), F.col("id").alias("answer_id"), F.col("other_t").alias("third_t"), F.col("other_id").alias("third_id"))
    return known.join(last, [*by, "answer_t", "answer_id"], "left").select(*key, "t", "id", "answer_t", "answer_id", "rnti", "third_t", "third_id")


def together(frame: DataFrame, one: str, other: str, order: str) -> DataFrame:
    """For each id of one kind the first id of another kind that stood in a row with it, and in how many rows the two stood."""
    both = frame.where(F.col(one).isNotNull() & F.col(other).isNotNull())
    return both.groupBy(one).agg(F.min_by(other, order).alias(other), F.count("*").alias("n"))
