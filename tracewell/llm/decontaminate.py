"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of the benchmark items.  Those of one length share a
shift table: for each block of two words it holds how far a search may jump because no
test string can end sooner.  Where the shift is 0 the block is looked up among the test
strings' last blocks, and each string found there is compared with the text word by word.
All segments of a batch of texts are searched in step, so that each move is one array
operation; a segment starts early enough for no occurrence to be lost.

The benchmark's items are dealt to blocks of some `block_words` words, by true counts, one
pass over the documents and one broadcast for each; an item is in one block, so a block holds
no more than about that and its longest item.  A benchmark of ten million words takes twenty
passes.  Words are compared by their 64-bit fingerprints.

Null texts have no words and are clean.  An item without words is no test string; an item
without id marks words but is not counted.  Equal rows get equal results, each its own row.
With an empty benchmark every document is clean; without documents the result is empty.
Other columns of the inputs are not looked at, whatever their names.  A text of any length
is one chunk of a task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .tables import map_batches, row_key, store

SEGMENT = 512
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # letters not lower-cased yet


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words of a chunk, and their rows."""
    low = bt.LOWER[data]
    start, end, rows = bt.words(low, offsets, bt.NON_ALNUM)
    return bt.word_prints(low, start, end), rows


@dataclass
class Patterns:
    """Test strings of one length with their shift table."""

    words: np.ndarray  # strings x length
    items: list[list[str]]

    LEAST_BITS, MOST_BITS = 18, 24  # of the shift table, which has four slots for each of the strings' blocks where it may

    def __post_init__(self):
        n, self.length = self.words.shape
        self.block = min(2, self.length)
        self.bits = min(self.MOST_BITS, max(self.LEAST_BITS, (4 * n * self.length).bit_length()))
        self.shifts = np.full(1 << self.bits, self.length - self.block + 1, np.int8 if self.length < 128 else np.int32)
        for end in range(self.block - 1, self.length):
            np.minimum.at(self.shifts, self.slot(self.keys(self.words, end)), self.length - 1 - end)
        last = self.keys(self.words, self.length - 1)
        order = np.argsort(last, kind="stable")
        self.words, self.items, self.last = self.words[order], [self.items[i] for i in order], last[order]

    def keys(self, words: np.ndarray, end: int) -> np.ndarray:
        return words[:, end] if self.block == 1 else self.pair(words[:, end - 1], words[:, end])

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return bt.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and string numbers of all occurrences in rows of words that begin at first and end before after."""
        lengths = after - first
        pieces = np.maximum(1, -(-lengths // SEGMENT))
        row = np.repeat(np.arange(len(first)), pieces)
        begin = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        at = begin + self.length - 1
        stop = np.minimum(begin + SEGMENT + self.length - 1, after[row])
        live = at < stop
        at, stop, ends = at[live], stop[live], []
        while len(at):
            key = text[at] if self.block == 1 else self.pair(text[at - 1], text[at])
            shift = self.shifts[self.slot(key)]
            hit = shift == 0
            if hit.any():
                ends.append((at[hit], key[hit]))
            at = at + np.maximum(shift, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, key = (np.concatenate(x) for x in zip(*ends))
        low, high = np.searchsorted(self.last, key, "left"), np.searchsorted(self.last, key, "right")
        n = high - low
        end, which = np.repeat(end, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        begin = end - self.length + 1
        for k in range(self.length):
            same = text[begin + k] == self.words[which, k]
            begin, which = begin[same], which[same]
        return begin, which


def build(items: list[tuple[str | None, str]], width: int) -> list[Patterns]:
    """Search tables for the windows of the items."""
    found: dict[int, dict[bytes, list[str]]] = {}
    for _, data, offsets in bt.chunks(pa.array([t or "" for _, t in items], pa.string())):
        prints, rows = word_prints(data, offsets)
        base = _
        for r in range(len(offsets) - 1):
            own = prints[np.searchsorted(rows, r) : np.searchsorted(rows, r, "right")]
            length = min(width, len(own))
            for i in range(len(own) - length + 1 if length else 0):
                found.setdefault(length, {}).setdefault(own[i : i + length].tobytes(), []).append(items[base + r][0])
    return [
        Patterns(np.frombuffer(b"".join(by), np.uint64).reshape(-1, length), [sorted({x for x in v if x is not None}) for v in by.values()])
        for length, by in found.items()
    ]


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
PART = "doc_id bigint, row bigint, n_words bigint, hits array<bigint>, items array<string>"


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def search(docs: DataFrame, tables: list[Patterns]) -> DataFrame:
    """For each document its word count, the places of hit words, and the items that occur."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)  # of one block, so of bounded size

    def step(batch: pa.RecordBatch) -> pa.Table:
        n_words, hits, items = [], [], []
        for _, data, offsets in bt.chunks(batch.column(2)):
            n = len(offsets) - 1
            prints, rows = word_prints(data, offsets)
            first, after = np.searchsorted(rows, np.arange(n)), np.searchsorted(rows, np.arange(n), "right")
            cover = np.zeros(len(prints) + 1, np.int64)
            own: list[set[str]] = [set() for _ in range(n)]
            for t in sent.value:
                begin, which = t.find(prints, first, after)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + t.length, -1)
                for r, w in np.unique(np.stack([rows[begin], which], 1), axis=0).tolist() if len(begin) else ():
                    own[r].update(t.items[w])
            hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            split = np.searchsorted(rows[hit], np.arange(1, n))
            hits += [(h - f).tolist() for h, f in zip(np.split(hit, split), first)]
            n_words += (after - first).tolist()
            items += [sorted(x) for x in own]
        return pa.table(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "row", "n_words", "hits", "items"],
        )

    return map_batches(docs, step, PART)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 500_000, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """How many words of each document lie in windows of benchmark items, and of how many items; row is the row's key."""
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), row_key(doc, text).alias("row"), F.col(text).alias("text"))
    tests = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    parts = None
    for b in range(blocks):
        held = [(r["item"], r["text"]) for r in tests.where(place == b).collect()]  # about block_words words
        part = search(rows, build(held, width))
        parts = part if parts is None else parts.unionByName(part)
    if blocks > 1:
        # repeated rows share a key; each block has found them equally often
        parts = (
            store(parts, "hits")
            .groupBy("doc_id", "row")
            .agg(
                F.max("n_words").alias("n_words"),
                F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
                F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
                (F.count("*") / blocks).cast("int").alias("copies"),
            )
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        )
    names = F.array_join(F.sort_array("items"), ",")
    n_hit = F.size("hits").cast("bigint")
    return parts.select(
        "doc_id", "row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
