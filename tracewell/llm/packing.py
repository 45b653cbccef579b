"""Best-fit packing: patterns of few lengths fitted by non-negative least squares.

A document's tokens, with an end token, are cut into pieces of a sequence's length at most.
Full pieces are sequences of their own.  For the others only the histogram of lengths is
needed, which is no longer than a sequence however large the corpus:

1. Patterns of up to three lengths that fill a sequence exactly are enumerated.
2. Repeat counts that fit the histogram are found by non-negative least squares, as
   multiplicative updates, and rounded down.
3. What is left is packed best-fit, longest first, on the histogram: equal lengths and
   equal gaps are handled together, by counts.

The result is a list of patterns with repeat counts.  A piece finds its place by its number
among the pieces of its length.  Those numbers come from counts by length and bucket, so no
task numbers more pieces than a bucket holds, even where all pieces are of one length.

Null texts are empty; an empty text is one end token.  Equal rows are packed each.  Which of
two pieces of equal length gets which place is decided by bucket, id and piece number.  An
empty table gives an empty result.  Other columns of the input are not looked at, whatever
their names.  A text of any length is encoded by one task, which holds its ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import map_batches, store


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end: int = 0
    steps: int = 300  # of the least-squares fit
    bucket_rows: int = 200_000
    slice_bytes: int = 4 << 20  # of text, that are encoded at once
    cache_words: int = 1_000_000  # distinct words whose ids a worker remembers


class WordTokens:
    """Token ids of texts, word by word.

    The tokenizer drops white space and never joins what white space parts, and it cuts
    full stops and commas off a letter before them, so each distinct word is encoded once
    without them, in lower case.  A worker keeps the first words that it meets for its later
    tasks, up to a limit; the commonest are among them.
    """

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[str, int] = {}
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids."""
        sizes, ids = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        letters = sum(map(str.isalpha, words))  # these come first
        for at, to in [*((i, min(i + 4096, letters)) for i in range(0, letters, 4096)), *((i, min(i + 4096, len(words))) for i in range(letters, len(words), 4096))]:
            part = words[at:to]
            code = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            whole = np.array(code.word_ids, np.int64)
            if at >= letters or whole.max() + 1 != len(part):  # a word is not always one of the tokenizer's
                code = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                whole = np.array(code.word_ids, np.int64)
            sizes[at : at + len(part)] = np.bincount(whole, minlength=len(part))
            ids.append(np.array(code.ids, np.uint32))
        return sizes, np.concatenate(ids)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and sizes of the words' ids, and the ids that they are in."""
        which = np.array([self.known.get(x, -1) for x in words], np.int64)
        new = np.flatnonzero(which < 0)
        new = new[np.argsort([not words[i].isalpha() for i in new], kind="stable")]
        names = [words[i] for i in new]
        sizes, ids = self.encode(names)
        start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        flat = np.concatenate([self.flat, ids])
        which[new] = len(self.start) - 1 + np.arange(len(new))
        if len(self.known) + len(new) <= self.limit:
            self.known.update(zip(names, which[new].tolist()))
            self.start, self.flat = start, flat
        return start[which], start[which + 1] - start[which], flat

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        held = pc.dictionary_encode(parts.flatten())
        low = pc.ascii_lower(held.dictionary)
        cores = pc.dictionary_encode(pc.replace_substring_regex(low, "([a-z])[.,]+$", "\\1"))
        core = cores.indices.to_numpy()
        names = cores.dictionary.to_pylist()
        tail = np.full(len(low), len(names))
        cut = np.flatnonzero(pc.binary_length(low).to_numpy() > pc.binary_length(cores.dictionary).to_numpy()[core]) if len(low) else np.zeros(0, np.int64)
        tails, at = np.unique([x[len(names[c]) :] for x, c in zip(low.take(pa.array(cut)).to_pylist(), core[cut])], return_inverse=True) if len(cut) else ([], [])
        tail[cut] = len(names) + 1 + np.asarray(at, np.int64)
        start, size, flat = self.look_up([*names, "", *map(str, tails)])

        # ids of the distinct words with what follows them, then of all words
        two = np.stack([core, tail], 1).ravel()
        own = flat[ranges(start[two], size[two])]
        length = size[two].reshape(-1, 2).sum(1)
        word = held.indices.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(length[word])])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return own[ranges((np.cumsum(length) - length)[word], length[word])], bounds


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first on, count of each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class WholeTokens:
    """Token ids of texts, each encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)


#: Texts on which a tokenizer shows whether it works word by word.
PROBES = (
    "One two  three", "words, with. marks., and... more,", " before and after ", "tab\tand\nline\n\nends", "UPPER Lower mIXed", "don't e.g. U.S.A. x.y,z 1,000.5 7.", "\u00e9t\u00e9. \u00c0 stra\u00dfe, \u00d1o.",
    "\u65e5\u672c\u8a9e. \u8a9e,", "a.,b ,c .d ... , .", "no\u00a0break \u2014 dash\u2026", "<s> [x] {y} #1 @z $5", "supercalifragilistic.", "",
)


def fitting(path: str, limit: int) -> WordTokens | WholeTokens:
    """Words one by one where the tokenizer works so, as far as the probes show; whole texts where it does not."""
    words, whole, texts = WordTokens(path, limit), WholeTokens(path), pa.array(PROBES, pa.large_string())
    same = all(np.array_equal(a, b) for a, b in zip(words.of(texts), whole.of(texts)))
    return words if same else whole


_workers: dict[str, WordTokens | WholeTokens] = {}


def worker_tokens(path: str, limit: int) -> WordTokens | WholeTokens:
    """What this worker has for a tokenizer, from earlier tasks too."""
    if path not in _workers:
        _workers[path] = fitting(path, limit)
    return _workers[path]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with texts of limit bytes or little more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)) + 1
        yield batch.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, tokenizer: str, how: Packing = Packing(), keep_ids: bool = True, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every row; ids are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(tokenizer, how.cache_words)
        for batch in batches:
            for part in slices(batch, how.slice_bytes):
                ids, bounds = tokens.of(part.column(1).cast(pa.large_string()))
                out = []
                for name, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(how.end)).astype("<u4")
                    for k in range(0, len(own), how.capacity):
                        raw = own[k : k + how.capacity].tobytes()
                        out.append((name, k // how.capacity, k, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.selectExpr(f"cast({doc} as bigint) doc_id", text).mapInArrow(run, PIECES)


def triples(have: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths, 0 for none, that fill a sequence exactly; lengths with a piece only."""
    there = np.zeros(capacity + 1, bool)
    there[have] = there[0] = True
    out = []
    for a in have.tolist():
        b = np.arange(0, min(a, capacity - a) + 1)
        c = capacity - a - b
        ok = (c <= b) & (c >= 0)
        b, c = b[ok], c[ok]
        ok = there[b] & there[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def least_squares(patterns: np.ndarray, counts: np.ndarray, steps: int) -> np.ndarray:
    """Repeat counts x >= 0 for which the patterns' lengths come near the histogram."""
    n = len(counts)
    real = (patterns > 0).astype(float)

    def gather(values: np.ndarray) -> np.ndarray:
        return (values[patterns] * real).sum(1)

    def spread(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (real * x[:, None]).ravel(), n)

    goal = gather(counts)
    uses = np.maximum(spread(np.ones(len(patterns))), 1)
    x = np.min(np.where(real > 0, (counts / uses)[patterns], np.inf), 1)
    for _ in range(steps):
        x = x * goal / np.maximum(gather(spread(x)), 1e-12)
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeat counts for a whole histogram: longest first, each into the least gap that holds it."""
    open_: dict[int, list[list]] = {}  # by gap: [lengths, repeats]
    done: list[tuple[tuple[int, ...], int]] = []
    gaps = np.zeros(capacity + 1, bool)

    def put(lengths: tuple[int, ...], gap: int, n: int) -> None:
        if gap == 0:
            done.append((lengths, n))
        else:
            open_.setdefault(gap, []).append([lengths, n])
            gaps[gap] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                per = capacity // length
                if left >= per:
                    put((length,) * per, capacity - per * length, left // per)
                if left % per:
                    put((length,) * (left % per), capacity - left % per * length, 1)
                break
            gap = int(fits[0]) + length
            own = open_[gap][-1]
            per = min(gap // length, left)
            n = min(own[1], left // per)
            own[1] -= n
            if not own[1]:
                open_[gap].pop()
                gaps[gap] = bool(open_[gap])
            put(own[0] + (length,) * per, gap - per * length, n)
            left -= n * per
    return done + [(x, n) for held in open_.values() for x, n in held]


def plan(counts: np.ndarray, how: Packing = Packing()) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use up a histogram of lengths below the capacity."""
    left, out = counts.astype(np.int64).copy(), []
    patterns = triples(np.flatnonzero(left), how.capacity)
    if len(patterns):
        repeats = np.floor(least_squares(patterns, left.astype(float), how.steps) + 1e-9).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            if not repeats[k]:
                break
            lengths = tuple(int(x) for x in patterns[k] if x)
            n = min(int(repeats[k]), *(int(left[x]) // lengths.count(x) for x in set(lengths)))
            if n:
                out.append((lengths, n))
                for x in lengths:
                    left[x] -= n
    return out + best_fit(left, how.capacity)


@dataclass
class Places:
    """For each length, in order of the number of a piece: the slots that it goes to."""

    begin: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, patterns: list[tuple[tuple[int, ...], int]], first: int) -> Places:
        slots: dict[int, list[tuple[int, int, int]]] = {}
        for lengths, n in patterns:
            at = 0
            for x in lengths:
                slots.setdefault(x, []).append((n, first, at))
                at += x
            first += n
        made = {x: np.array(v, np.int64).T for x, v in slots.items()}
        return cls({x: np.cumsum(v[0]) - v[0] for x, v in made.items()}, {x: v[1] for x, v in made.items()}, {x: v[2] for x, v in made.items()})

    def find(self, length: np.ndarray, number: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = number.copy(), np.zeros(len(number), np.int64)  # full pieces come first
        for x in np.unique(length[length < capacity]).tolist():
            own = np.flatnonzero(length == x)
            slot = np.searchsorted(self.begin[x], number[own], "right") - 1
            sequence[own] = self.sequence[x][slot] + number[own] - self.begin[x][slot]
            offset[own] = self.offset[x][slot]
        return sequence, offset


def place(table: DataFrame, how: Packing = Packing()) -> DataFrame:
    """sequence_id and offset for every row of a stored table of pieces."""
    lengths = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    full = lengths.pop(how.capacity, 0)
    counts = np.zeros(how.capacity, np.int64)
    for x, n in lengths.items():
        counts[x] = n
    places = Places.of(plan(counts, how), full)

    # buckets by length: enough of them for the commonest one
    parts = max(1, -(-max([full, *lengths.values()]) // how.bucket_rows))
    keyed = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    held = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = held.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "base")
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    numbered = keyed.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("inside"))

    def step(batch: pa.RecordBatch) -> pa.Table:
        t = pa.Table.from_batches([batch])
        sequence, offset = places.find(t.column("length").to_numpy(), t.column("number").to_numpy(), how.capacity)
        return t.drop_columns(["number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return map_batches(
        numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number"), step, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def pack(docs: DataFrame, tokenizer: str, how: Packing = Packing(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its place."""
    return place(store(pieces(docs, tokenizer, how, keep_ids=False, doc=doc, text=text).drop("ids"), "pieces"), how)


def sequences(docs: DataFrame, tokenizer: str, how: Packing = Packing(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """sequence_id and ids of every packed sequence; repeated rows may change places among each other."""
    table = store(pieces(docs, tokenizer, how, doc=doc, text=text), "pieces")
    ids = table.select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    placed = place(table.drop("ids"), how).join(ids.withColumnRenamed("doc_id", "d").withColumnRenamed("piece", "p").withColumnRenamed("ids_crc32", "c"), F.expr("doc_id <=> d and piece = p and ids_crc32 = c"))
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # one sequence's pieces
    return placed.groupBy("sequence_id").agg(F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
