"""The trie of conversations' prefixes: who shares which first turns, and what sharing them saves.

A prefix is known by a digest, the sum of strong hashes of its turns with their places, so that
the digests of all prefixes are running sums, and a long conversation is dealt to many tasks.
The owner of a node is its least member: the minimum over the node's digest.  If a conversation
owns a node, it owns all that it has below: its nodes are a chain from its first owned depth on.
That depth is found by binary search, each step one join of all conversations with the owners.
A chain hangs on the node above its first one.  What hangs on a chain is summed bottom-up, with
steps of 1, 2, 4, ... chains at once, so a tree of chains of any height takes few rounds, and
then along each chain.

Nodes that very many conversations share are looked up by broadcast, in a list of
bounded size, so that a first turn of a third of all conversations fills no one task; other
joins are by keys that are spread.  That a node's members that end there are hashed in one
stream is SHA-256's nature; it gets their ids in sorted blocks and holds one batch of them.

Digests have 120 bits.  Null roles and texts are empty ones; rows without a conv_id are of no
conversation and dropped.  Turns go by turn, null first; equal ones by a digest of role and
text, so repeated rows are repeated turns, side by side.  Empty tables have no nodes.  Other
columns are not looked at, whatever their names.  Texts are read once and not shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import look_up, often_asked
from ..operators.scans import running
from .tables import store

BLOCK = 4096  # turns or ids in what one row of a join or one string of ids stands for


@dataclass(frozen=True)
class Rebuild:
    """Conversation c becomes the first crc32(c) % heads turns of c - c % family, then its own after as many."""

    family: int = 20
    heads: int = 4


def block(x: Column | str) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / BLOCK)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and words of all turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("bigint")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))
    return running(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], {"place": F.lit(1)}).drop("turn")


def rebuilt(turns: DataFrame, how: Rebuild) -> tuple[DataFrame, DataFrame]:
    """All conversations with their sizes, and their turns: conv_id, depth, digest and words."""
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    own = F.col("conv_id")
    head = F.crc32(own.cast("string").cast("binary")) % how.heads
    bases = convs.where(own % how.family == 0).select(own.alias("base"), F.col("n").alias("base_n"))
    lists = convs.withColumn("base", own - own % how.family).withColumn("head", head).join(bases, "base", "left")
    lists = lists.withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    lists = store(lists.select("conv_id", "base", "n", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("size")), "conversations")
    parts = lists.select("conv_id", "head", "taken", F.explode(F.sequence(F.lit(0).cast("bigint"), block("n"))).alias("part"))
    after = turns.withColumn("part", block("place")).join(parts, ["conv_id", "part"]).where("place > head")
    after = after.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "digest", "words")
    heads = turns.where((own % how.family == 0) & (F.col("place") < how.heads)).select(own.alias("base"), F.col("place").alias("depth"), "digest", "words")
    before = lists.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("depth <= taken")
    return lists, after.unionByName(before.select(*after.columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words of the last turn, and the digest (s1, s2) of all turns up to it."""
    placed = F.sha2(F.concat("digest", F.lit(":"), F.col("depth").cast("string")), 256)
    lanes = {f"s{k}": F.conv(F.substring(placed, 15 * k - 14, 15), 16, 10).cast("decimal(20)") for k in (1, 2)}
    return running(turns, ["conv_id"], ["depth"], lanes).drop("digest")


def first_owned(lists: DataFrame, owned: DataFrame, longest: int) -> DataFrame:
    """lists with first, the least depth that a conversation owns, or its size and one more."""
    state = lists.select("conv_id", "size", F.lit(0).cast("bigint").alias("lo"), (F.col("size") + 1).alias("hi"))
    for _ in range(math.ceil(math.log2(longest + 2))):
        probe = state.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        found = probe.join(owned.withColumn("owns", F.lit(True)), ["conv_id", "depth"], "left")
        is_open, owns = F.col("lo") < F.col("hi"), F.col("owns").isNotNull()
        state = found.select("conv_id", "size", F.when(is_open & ~owns, F.col("depth") + 1).otherwise(F.col("lo")).alias("lo"), F.when(is_open & owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
    return state.select("conv_id", "size", F.col("lo").alias("first"))


def bottom_up(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, saved, leaves) with saved and leaves summed over all chains below, in rounds of double reach."""
    table = store(chains, "chains")
    total = table.count()
    while not table.where("up is not null").isEmpty():
        asked = table.where("up is not null").groupBy("up").agg(F.count("*").alias("n"), F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        above = table.select(F.col("conv_id").alias("up"), F.col("up").alias("next")).join(asked.select("up", "n"), "up")
        gained = table.join(asked.select(F.col("up").alias("conv_id"), "more_saved", "more_leaves"), "conv_id", "left")
        moved = gained.select("conv_id", "up", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("saved", "leaves")))
        table = store(look_up(moved, above, ["up"], often_asked("n", total)).select("conv_id", F.col("next").alias("up"), "saved", "leaves"), "chains")
    return table


def hashed_ends(ends: DataFrame) -> DataFrame:
    """owner, depth, and the hash of the sorted ids of those that end there."""
    sorted_ids = F.array_join(F.array_sort(F.collect_list("conv_id")), ",")
    blocks = ends.groupBy("owner", "depth", block("conv_id").alias("block")).agg(sorted_ids.alias("ids"))
    dealt = blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").select("owner", "depth", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, depth) == at:
                    state.update(b"," + ids.encode())
                else:
                    done += [(*at, state.hexdigest())] if at else []
                    at, state = (owner, depth), hashlib.sha256(ids.encode())
            yield table(done)
        yield table([(*at, state.hexdigest())] if at else [])

    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds)], ["owner", "depth", "ends_sha256"])

    return dealt.mapInArrow(run, "owner bigint, depth bigint, ends_sha256 string")


def trie(conversations: DataFrame, how: Rebuild = Rebuild()) -> DataFrame:
    """A row for each node: its owner, depth and parent, its members, children and leaves, the words that sharing saves, and who ends there."""
    lists, turns = rebuilt(numbered(conversations), how)
    every = prefixes(turns)
    digest = ["depth", "s1", "s2"]
    minima = store(every.groupBy(*digest).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words")), "minima")
    least, n, longest = lists.agg(F.min("conv_id"), F.count("*"), F.max("size")).first()
    root = every.sparkSession.createDataFrame([(least, n)] if n else [], "owner bigint, n_convs bigint")
    nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    zero = F.lit(0).cast("bigint")
    nodes = nodes.unionByName(root.select("owner", zero.alias("depth"), "n_convs", zero.alias("saved")))

    found = store(first_owned(lists, nodes.select(F.col("owner").alias("conv_id"), "depth"), longest or 0), "first_owned")
    rows = minima.agg(F.sum("n_convs")).first()[0] or 0
    asked = found.where("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")).join(every, ["conv_id", "depth"])
    above = look_up(store(asked.select("conv_id", *digest), "asked"), minima.select(*digest, "owner", "n_convs"), digest, often_asked("n_convs", rows)).select("conv_id", "owner")
    top = found.where("first = 1").select("conv_id", F.lit(least).cast("bigint").alias("owner"))
    hung = store(found.join(above.unionByName(top), "conv_id", "left").withColumnRenamed("owner", "up"), "hung")  # up: the owner one above the first owned depth

    ends = hung.select(F.when(F.col("first") <= F.col("size"), F.col("conv_id")).otherwise(F.col("up")).alias("owner"), F.col("size").alias("depth"), "conv_id")
    chains = hung.where("first <= size")
    at = ["owner", "depth"]
    branches = chains.where("up is not null").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("n_branches"))
    leaf = chains.select(F.col("conv_id").alias("owner"), F.col("size").alias("depth")).join(branches, at, "left_anti").withColumn("leaf", F.lit(1).cast("bigint"))
    own = nodes.join(leaf, at, "left").groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"), F.count("leaf").alias("leaves"))
    sums = bottom_up(chains.select("conv_id", "up").join(own, "conv_id"))
    held = chains.select("conv_id", "up", "first").join(sums.select("conv_id", "saved", "leaves"), "conv_id").where("up is not null")
    hanging = held.groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.count("*").alias("n_branches"))

    parts = chains.select(F.col("conv_id").alias("owner"), "up", "first", "size", F.explode(F.sequence(block("first"), block("size"))).alias("part"))
    body = nodes.withColumn("part", block("depth")).join(parts, ["owner", "part"]).join(hanging, at, "left").join(leaf, at, "left").join(hashed_ends(ends), at, "left")
    summed = running(
        body, ["owner"], [F.col("depth").desc()], {"saved_tokens": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "n_leaves": F.coalesce("leaf", F.lit(0)) + F.coalesce("more_leaves", F.lit(0))}
    )
    return summed.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("owner")).alias("parent_conv_id"), "n_convs",
        (F.coalesce("n_branches", F.lit(0)) + (F.col("depth") < F.col("size")).cast("bigint")).alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"), F.col("saved_tokens").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
