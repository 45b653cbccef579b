"""Language-model scoring by Katz backoff.

An n-gram that was seen c times in training has the Good-Turing discounted probability
d(c) * c / c(history).  What its history's continuations leave goes to the others, in
proportion to the next shorter history's probabilities, so each history's distribution sums
to one.  A word that was never seen is one more event of the shortest, empty history.

* Texts are read once, into chunks: a chunk holds its texts' words as numbers into its own
  list of distinct fingerprints.
* Level by level, each chunk sends its distinct n-grams, with counts and with the counts that
  tell the next lower level's probabilities, to buckets.  A bucket has all n-grams of a history.  It adds them up,
  writes its part of the model table, where that is asked for, and answers every chunk with counts and with the sums
  that the backoff weights are made of.  Discounts are known when all buckets have counted.
  Single words are given short numbers, which name them from then on.
  Answers are dealt to the chunks once, into a table that lies by chunk as the chunks do.
  Histories of two words are dealt by the first, so that near names are sent together.
* A history that occurs once in training, and in no text that is only scored, is lonely: one
  token has it, whose n-gram occurs once too.  Its chunk knows that from the level below and
  asks nothing; such n-grams are counted, and stay in the chunks, which have them.
* Each chunk works out the probabilities of its tokens from the answers, recursively from
  the empty history up.

A history with more than `heavy` tokens is salted: its n-grams are spread over several
buckets, and its sums are added afterwards.  There are at most 65,536 such histories, as the
limit grows with the corpus beyond that; they, the counts of counts and nothing else reach
the driver.

A null text is empty and is one end token.  Equal texts score alike if they are all in
training or all held out, and in any case by the same model.  Repeated rows count each.
Without training rows every probability is that of the one unknown word, 1.  An empty table
gives an empty result.  Other columns of the input are not looked at, whatever their names.
A text of any length is in one chunk, which one task holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .tables import forget, shared_folder, shuffles_dropped, store

U = np.uint64
I = np.int32  # of places in a chunk
SQUEEZER, EXPANDER = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
END, ROOT, STRIDE = U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D1)


@dataclass(frozen=True)
class Katz:
    order: int = 2
    discounted: int = 5  # counts up to this are discounted
    chunk_bytes: int = 6 << 20
    bucket_grams: int = 1_200_000
    heavy: int = 200_000
    most_heavy: int = 65_536


def squeeze(x: np.ndarray) -> bytes:
    """An array of non-negative integers in the least type that holds them, or of floats, compressed."""
    if x.dtype.kind in "ui":
        x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T  # bytes of one weight together
    return x.dtype.char.encode() + SQUEEZER.compress(planes.tobytes())


def expand(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:1].decode())
    planes = np.frombuffer(EXPANDER.decompress(b[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


CHUNKS = "chunk bigint, docs array<bigint>, held array<boolean>, sizes binary, words binary, tokens binary, n_tokens bigint, n_words bigint, train_tokens bigint, train_docs bigint"


def chunks(docs: DataFrame, how: Katz) -> DataFrame:
    """Texts as numbers into the distinct words of their chunk."""

    def row(number: int, ids: list, held: list, sizes: list, tokens: list) -> pa.RecordBatch:
        size, words = np.concatenate(sizes), np.concatenate(tokens)
        coded = pa.array(words).dictionary_encode()
        names, place = np.unique(coded.dictionary.to_numpy(zero_copy_only=False), return_inverse=True)
        which = place[coded.indices.to_numpy(zero_copy_only=False)]
        train = ~np.array(held, bool)
        cells = [number, ids, held, squeeze(size), squeeze(np.diff(names, prepend=U(0))), squeeze(which), len(words), len(names), int(size[train].sum()), int(train.sum())]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 3, *[pa.int64()] * 4]
        return pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds)], [x.split()[0] for x in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, tokens, gathered = [], [], [], [], 0
        for batch in batches:
            for base, data, offsets in bt.chunks(batch.column(2)):
                n = len(offsets) - 1
                low = bt.LOWER[data]
                start, end, rows = bt.words(low, offsets, bt.SPACE)
                size = bt.per_row(rows, n) + 1
                own = np.full(size.sum(), END)
                place = np.ones(len(own), bool)
                place[np.cumsum(size) - 1] = False
                own[place] = bt.word_prints(low, start, end)
                ids += batch.column(0).slice(base, n).to_pylist()
                held += batch.column(1).slice(base, n).to_pylist()
                sizes.append(size)
                tokens.append(own)
                gathered += len(data) + 64 * n
                if gathered >= how.chunk_bytes:
                    yield row(number, ids, held, sizes, tokens)
                    number += 1
                    ids, held, sizes, tokens, gathered = [], [], [], [], 0
        if ids:
            yield row(number, ids, held, sizes, tokens)

    return docs.mapInArrow(run, CHUNKS)


@dataclass
class Level:
    """What is known of a level when it has been counted."""

    number: int
    buckets: int
    heavy: np.ndarray  # salted histories, in order
    salts: np.ndarray
    discounts: np.ndarray = field(default_factory=lambda: np.ones(1))
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # of the salted histories
    lower: np.ndarray = field(default_factory=lambda: np.zeros(0))
    types: int = 0
    packed: bool = False  # its n-grams, as histories, are named by two numbers of words side by side
    leads: Level | None = None  # the level below, if histories are so named: they are dealt by the first word

    def deal(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        dealt = history
        if self.leads:  # so that those of a word, which have near names, are sent together
            lead = history >> U(32)
            dealt = bt.mix(lead + self.leads.salt(lead, history) * STRIDE)
        return (bt.mix(dealt + self.salt(history, word) * STRIDE) % U(self.buckets)).astype(np.int64)

    def salt(self, history: np.ndarray, by: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(history), U)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, history), len(self.heavy) - 1)
            own = self.heavy[at] == history
            salt[own] = bt.mix(by[own] + STRIDE) % self.salts[at[own]]
        return salt


def discounts(census: np.ndarray, k: int) -> np.ndarray:
    """d(0..k) from the numbers of n-grams seen 1..k+1 times; where Good-Turing has no sound value, half a count is taken off."""
    for top in range(k, 0, -1):
        n, r = census[: top + 1].astype(float), np.arange(1, top + 1)
        if (n > 0).all() and (tail := (top + 1) * n[top] / n[0]) < 1:
            d = ((r + 1) * n[1:] / (r * n[:-1]) - tail) / (1 - tail)
            if ((d > 0) & (d < 1)).all():
                return np.concatenate([[1.0], d, np.ones(k - top)])
    return np.concatenate([[1.0], 1 - 0.5 / np.arange(1, k + 1)])


def distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of numbers below bound, in order, a place of each, and which one each is; the numbers are overwritten."""
    bits = len(keys).bit_length()
    if bound.bit_length() + bits > 64:
        keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
        return keys, at.astype(I), which.astype(I)
    keys <<= U(bits)
    keys |= np.arange(len(keys), dtype=U)
    keys.sort()  # numbers with their places: much faster than to sort places by numbers
    place = (keys & U((1 << bits) - 1)).astype(I)
    keys >>= U(bits)
    lead = runs(keys)
    which = np.empty(len(keys), I)
    which[place] = np.repeat(np.arange(len(lead), dtype=I), np.diff(np.append(lead, len(keys))))
    return keys[lead], place[lead], which


@dataclass
class Known:
    """What is known of a chunk's tokens at a level: of tells each token's n-gram, the last one stands for all that follow lonely histories."""

    of: np.ndarray
    p: np.ndarray
    count: np.ndarray
    whole: np.ndarray  # what the count is divided by
    alone: np.ndarray


class Chunk:
    """A chunk's tokens, and its distinct n-grams level by level."""

    def __init__(self, row: dict):
        self.size, self.names, self.tokens = expand(row["sizes"]).astype(np.int64), np.cumsum(expand(row["words"]), dtype=U), expand(row["tokens"]).astype(I)
        self.first = np.cumsum(self.size) - self.size
        self.train = np.repeat(~np.array(row["held"], bool), self.size)
        self.histories = np.array([ROOT])  # names of the chunk's histories, and which one each token has
        self.history = np.zeros(len(self.tokens), I)
        self.lonely = np.zeros(len(self.tokens), bool)  # whether a token's history occurs nowhere else

    def grams(self, level: Level) -> None:
        """The distinct n-grams, but for those of lonely histories, in the order of history and word; order sorts them by bucket."""
        n = len(self.names)
        if level.number == 1:  # words are distinct as they are
            self.asks, self.which, self.word, self.inverse = np.arange(len(self.tokens), dtype=I), np.zeros(n, I), np.arange(n, dtype=I), self.tokens
            self.at = np.empty(n, I)
            self.at[self.tokens] = self.asks
        else:
            self.asks = np.flatnonzero(~self.lonely).astype(I)
            keys = self.history[self.asks].astype(U)
            keys *= U(n)
            keys += self.tokens[self.asks].astype(U)
            keys, at, self.inverse = distinct(keys, len(self.histories) * n)
            self.at = self.asks[at]
            self.which = (keys // U(n)).astype(I)
            self.word = (keys - self.which.astype(U) * U(n)).astype(I)
        bucket = level.deal(self.histories[self.which], self.names[self.word]).astype(np.min_scalar_type(level.buckets))
        self.order = np.argsort(bucket, kind="stable").astype(I)
        self.bucket = bucket[self.order]

    def go_on(self, level: Level, known: Known) -> None:
        """Histories of the next level: each token's n-gram is the next token's history, lonely if the n-gram is alone."""
        alone = known.alone[known.of]
        self.lonely = np.append(alone[:1], alone[:-1])
        self.lonely[self.first] = False
        names, gram = follow(self.histories[self.which], self.names[self.word], level), known.of
        if (names[1:] < names[:-1]).any():  # histories and words stand in the order of their names
            by_name = np.argsort(names)
            place = np.zeros(len(names) + 1, I)
            place[by_name] = np.arange(len(names), dtype=I)
            names, gram = names[by_name], place[gram]
        if level.number == 1:
            self.names, self.tokens = names, gram
        self.histories = np.append(start(level), names)
        self.history = np.append(gram[:1], gram[:-1])  # after a lonely history it is not looked at
        self.history += I(1)
        self.history[self.first] = 0


def follow(history: np.ndarray, word: np.ndarray, level: Level) -> np.ndarray:
    """Names of a level's n-grams as histories; a single word has a number of its own, the least for the commonest."""
    if level.number == 1:
        return word
    return (history << U(32)) | word if level.packed else bt.mix(history * STRIDE + word)


def start(level: Level) -> np.uint64:
    """The history of a text's first token after this level; no word has the number 0."""
    return U(0) if level.number == 1 or level.packed else bt.mix(np.array([level.number + 1], U) + ROOT)[0]


def steps(w: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """How far each word of a history, in order, is from the one before it; the first from 0."""
    out = np.diff(w, prepend=U(0))
    out[lead] = w[lead]
    return out


def unsteps(d: np.ndarray, lead: np.ndarray, run: np.ndarray) -> np.ndarray:
    total = np.cumsum(d, dtype=U)
    return total - np.repeat(total[lead] - d[lead], run)


def slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)]))


def runs(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


REQUESTS = "bucket int, chunk bigint, histories binary, runs binary, words binary, counts binary, lower binary, whole binary, lonely bigint"


def request(number: int, chunk: Chunk, level: Level, below: Known | None) -> pa.RecordBatch:
    """The chunk's n-grams for each bucket, with the counts that tell its tokens' probabilities at the level below."""
    chunk.grams(level)
    train = chunk.train[chunk.asks]
    count = np.bincount(chunk.inverse, train, len(chunk.at)).astype(np.int64) * 2
    count[chunk.inverse[~train]] |= 1  # an n-gram of a text that is only scored
    count, lonely = count[chunk.order], int(chunk.lonely.sum())
    h, w = chunk.histories[chunk.which[chunk.order]], chunk.names[chunk.word[chunk.order]]
    low = all_ = np.zeros(len(h), np.uint8)
    if below:
        gram = below.of[chunk.at[chunk.order]]
        low, all_ = below.count[gram], below.whole[gram]
    out = []
    for b, i, j in slices(chunk.bucket):
        own = runs(h[i:j])  # ascending
        out.append((b, number, squeeze(np.diff(h[i:j][own], prepend=U(0))), squeeze(np.diff(np.append(own, j - i))), squeeze(steps(w[i:j], own)), squeeze(count[i:j]), squeeze(low[i:j]), squeeze(all_[i:j][own]), 0 if out else lonely))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.int64()]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in REQUESTS.split(", ")])


COUNTED = "kind string, bucket int, chunk bigint, histories binary, runs binary, words binary, counts binary, sums binary, lower binary, census array<bigint>"


def count(table: pa.Table, level: Level, below: Level | None, k: int, limit: int, keep_model: bool) -> pa.Table:
    """One bucket: its part of the model, if that is kept, an answer to every request, counts of counts, and what is heavy."""
    rows = table.to_pylist()
    length = [expand(r["runs"]).astype(np.int64) for r in rows]
    names = [np.cumsum(expand(r["histories"]), dtype=U) for r in rows]
    h = np.concatenate([np.repeat(a, b) for a, b in zip(names, length)])
    w = np.concatenate([unsteps(expand(r["words"]).astype(U), np.cumsum(m) - m, m) for r, m in zip(rows, length)])
    n = np.concatenate([expand(r["counts"]).astype(np.int64) for r in rows])
    low = np.concatenate([expand(r["lower"]).astype(np.int64) for r in rows])
    if below:  # only n-grams that were seen count, and what follows them was seen at the level below
        of = np.concatenate([np.repeat(expand(r["whole"]).astype(np.int64), m) for r, m in zip(rows, length)])
        low = below.discounts[np.where(low <= k, low, 0)] * low / np.maximum(of, 1)
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order] >> 1, at)
    alone = (total == 1) & ~np.bitwise_or.reduceat(n[order] & 1, at).astype(bool)
    h, w, low = h[at], w[at], low[order][at]
    gram = np.empty(len(order), np.int64)
    gram[order] = np.cumsum(new) - 1

    own = runs(h)
    sums = np.stack([np.add.reduceat(total, own), *(np.add.reduceat((total == r).astype(np.int64), own) for r in range(1, k + 1))])
    seen = np.add.reduceat(np.where(total > 0, low, 0.0), own)
    out = []
    b, place = rows[0]["bucket"], 0
    names_of = numbers(total, b, level) if level.number == 1 else w
    for r, a, m in zip(rows, names, length):
        which = np.searchsorted(h[own], a)
        c = total[gram[place : place + m.sum()]]
        back = backs_off(c, np.cumsum(m) - m)
        given = squeeze(names_of[gram[place : place + m.sum()]]) if level.number == 1 else None
        out.append(("answer", b, r["chunk"], None, None, given, squeeze(2 * c + alone[gram[place : place + m.sum()]]), squeeze(sums[:, which].ravel()), squeeze(seen[which[back]])))
        place += m.sum()
    known = total > 0
    if keep_model and known.any():
        lead = runs(h[known])
        mine = np.searchsorted(h[own], h[known][lead])
        out.append(("model", b, None, squeeze(np.diff(h[known][lead], prepend=U(0))), squeeze(np.diff(np.append(lead, known.sum()))), squeeze(steps(w[known], lead)), squeeze(total[known]), squeeze(sums[:, mine].ravel()), squeeze(seen[mine])))
    census = np.array([(total == r).sum() for r in range(1, k + 2)] + [known.sum(), len(total)])
    census[[0, k + 1]] += sum(r["lonely"] for r in rows)  # what follows a lonely history is seen once
    if (big := total > limit).any():
        out.append(("heavy", b, None, follow(h[big], names_of[big], level).tobytes(), None, None, squeeze(total[big]), None, None))
    if (salted := np.isin(h[own], level.heavy)).any():
        out.append(("salted", b, None, h[own][salted].tobytes(), None, None, None, squeeze(sums[:, salted].ravel()), squeeze(seen[salted])))
    out = [(*x, None) for x in out] + [("census", b, *[None] * 7, census.tolist())]
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64())]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in COUNTED.split(", ")])


def numbers(total: np.ndarray, bucket: int, level: Level) -> np.ndarray:
    """A number for each word of a bucket, no other word's, from 1: the commoner the word, the less."""
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return (rank * level.buckets + bucket + 1).astype(U)


def backs_off(c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a history has a continuation that was never seen; only such ones need the sum of the seen ones."""
    return np.logical_or.reduceat(c == 0, own)


def probabilities(chunk: Chunk, level: Level, answers: list[dict], below: Known | None) -> Known:
    """What is known of the chunk's n-grams at this level."""
    chunk.grams(level)
    by = {a["bucket"]: a for a in answers}
    k, n = len(level.discounts) - 1, len(chunk.at)
    # after a lonely history comes what came after it in training
    once = np.zeros((k + 1, 1), np.int64)
    once[:2] = 1
    one = backoff(once, np.zeros(1), level)[1][0]
    of = np.full(len(chunk.tokens), n, I)
    of[chunk.asks] = chunk.inverse
    out = Known(of, np.full(n + 1, level.discounts[1] / one), np.ones(n + 1, np.int64), np.full(n + 1, one, np.int64), np.ones(n + 1, bool))
    given = np.empty(n, U)
    for b, i, j in slices(chunk.bucket):
        at = chunk.order[i:j]
        h = chunk.which[at]
        own = runs(h)
        run = np.diff(np.append(own, j - i))
        c = expand(by[b]["counts"]).astype(np.int64)
        out.alone[at], c = c & 1, c >> 1
        sums, seen = expand(by[b]["sums"]).astype(np.int64).reshape(k + 1, -1), np.zeros(len(own))
        seen[backs_off(c, own)] = expand(by[b]["lower"])
        if len(level.heavy):
            name = chunk.histories[h[own]]
            big = np.minimum(np.searchsorted(level.heavy, name), len(level.heavy) - 1)
            salted = level.heavy[big] == name
            sums[:, salted], seen[salted] = level.sums[:, big[salted]], level.lower[big[salted]]
        alpha, whole = backoff(sums, seen, level)
        d = level.discounts[np.where(c <= k, c, 0)]
        whole = np.repeat(whole, run)
        low = below.p[below.of[chunk.at[at]]] if below else 1 / (level.types + 1)
        out.p[at] = np.where(c > 0, d * c / np.maximum(whole, 1), np.repeat(alpha, run) * low)
        out.count[at], out.whole[at] = c, whole
        if level.number == 1:
            given[at] = expand(by[b]["words"])
    if level.number == 1:  # each word is one n-gram here
        chunk.names = given
    return out


def backoff(sums: np.ndarray, seen: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights of histories, and what their counts are divided by.

    A history all of whose continuations are too common to be discounted gives up one count.
    """
    k = len(level.discounts) - 1
    total, few = sums[0], sums[1:]
    r = np.arange(1, k + 1)[:, None]
    big = total - (r * few).sum(0)
    whole = total + (few[level.discounts[1:] < 1].sum(0) == 0)
    mass = (level.discounts[1:, None] * r * few).sum(0) + big
    alpha = np.where(total > 0, (1 - mass / np.maximum(whole, 1)) / np.maximum(1 - seen, 1e-15), 1.0)
    return alpha, whole


def walk(row: dict, levels: list[Level], answers: list[dict], last: bool = False) -> tuple[Chunk, Known, Known]:
    """The chunk, ready for the next level if there is one, and what is known at the first and at the last of the levels."""
    chunk, known = Chunk(row), []
    for level in levels:
        known = [*known[:1], probabilities(chunk, level, [a for a in answers if a["level"] == level.number], known[-1] if known else None)]
        if not last or level is not levels[-1]:
            chunk.go_on(level, known[-1])
    return chunk, known[0], known[-1]


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def katz_scores(docs: DataFrame, learn_from, how: Katz = Katz(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model that learns from those where learn_from holds; the model table is not written."""
    return train(docs, learn_from, how, doc, text, keep_model=False)[0]


def train(docs: DataFrame, learn_from, how: Katz = Katz(), doc: str = "doc_id", text: str = "text", keep_model: bool = True) -> tuple[DataFrame, DataFrame, list[Level]]:
    """The scores, the model table (partitioned by level; empty unless it is to be kept) and the levels' discounts.

    The scores come of the answers to the chunks, the model table is for other uses.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("bigint").alias("doc_id"), (~F.coalesce(learn_from, F.lit(False))).alias("held"), F.col(text).alias("text"))
    # bucketed by chunk, so that answers come to the chunks and chunks stay where they are
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = uuid.uuid4().hex

    def by_chunk(df: DataFrame, name: str) -> DataFrame:
        """The rows added to a table, and the whole of it."""
        with shuffles_dropped(spark):
            df.write.mode("append").option("path", f"{shared_folder(spark)}/tables/{name}_{made}").option("compression", "none").bucketBy(parts, "chunk").format("parquet").saveAsTable(f"{name}_{made}")
        return spark.table(f"{name}_{made}")

    held = by_chunk(chunks(rows, how), "chunks")
    whole = held.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"), F.sum("train_tokens").alias("train"), F.sum("train_docs").alias("docs")).first()
    tokens, n_train = whole["tokens"] or 0, whole["train"] or 0
    limit = max(how.heavy, n_train // how.most_heavy)

    def buckets(asked: int | None) -> int:
        return max(1, -(-(asked or 0) // how.bucket_grams))

    def salts(total: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-total.astype(np.int64) // limit)).astype(U)

    levels, tables, answers = [], [], None
    heavy, totals = np.array([ROOT]), np.array([max(tokens, 1)])
    for number in range(1, how.order + 1):
        order = np.argsort(heavy)
        level = Level(number, buckets(whole["words"] if number == 1 else tokens), heavy[order], salts(totals[order]))
        done = list(levels)
        levels.append(level)
        level.leads = done[-1] if done and done[-1].packed else None
        level.packed = number == 2 and (most + 1) * levels[0].buckets < 1 << 32  # more than the greatest number of a word

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                if done:
                    chunk, _, known = walk(row, done, row.pop("answers"))
                    yield request(row["chunk"], chunk, level, known)
                else:
                    yield request(row["chunk"], Chunk(row), level, None)

        requests = joined(held, answers).mapInArrow(ask, REQUESTS)
        k = how.discounted

        def add(table: pa.Table) -> pa.Table:
            return count(table, levels[-1], levels[-2] if len(levels) > 1 else None, k, limit, keep_model)

        table = store(requests.groupBy("bucket").applyInArrow(add, COUNTED), f"katz-level{number}", "kind")
        small = table.where(F.col("kind").isin("heavy", "salted")).select("kind", "histories", "counts", "sums", "lower").toArrow().to_pylist()  # heavy histories
        held_by = [F.get("census", F.lit(i)) for i in range(k + 3)]
        sums = table.where("kind = 'census'").agg(*(F.coalesce(x, F.lit(0)) for x in (*map(F.sum, held_by[:-1]), F.max(held_by[-1])))).first()  # counts of counts of all buckets
        census, most = np.array(sums[:-1], np.int64), sums[-1]
        level.discounts, level.types = discounts(census[: k + 1], k), int(census[-1])
        level.sums, level.lower = np.zeros((k + 1, len(level.heavy)), np.int64), np.zeros(len(level.heavy))
        for r in small:
            if r["kind"] == "salted":
                at = np.searchsorted(level.heavy, np.frombuffer(r["histories"], U))
                level.sums[:, at] += expand(r["sums"]).astype(np.int64).reshape(k + 1, -1)
                level.lower[at] += expand(r["lower"])
        if number == 1:
            level.lower[:] = level.types / (level.types + 1)
        own = [(np.frombuffer(r["histories"], U), expand(r["counts"]).astype(np.int64)) for r in small if r["kind"] == "heavy"]
        heavy, totals = (np.concatenate(x) for x in zip(*own)) if own else (np.zeros(0, U), np.zeros(0, np.int64))
        if (whole["docs"] or 0) > limit:
            heavy, totals = np.append(heavy, start(level)), np.append(totals, whole["docs"])
        tables.append(table.where("kind = 'model'").select(F.lit(number).alias("level"), "bucket", "histories", "runs", "words", "counts", "sums", "lower"))
        said = table.where("kind = 'answer'").select(F.lit(number).alias("level"), "bucket", "chunk", "words", "counts", "sums", "lower").repartition(parts, "chunk")
        answers = by_chunk(said, "answers")  # dealt to the chunks once, for all levels above
        if not keep_model:
            forget([table])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk, single, known = walk(row, levels, row.pop("answers"), last=True)
            base = np.log10((single.count + 0.1) / (n_train + 0.1 * (levels[0].types + 1)))
            sums = [np.add.reduceat(x[of], chunk.first) for x, of in (((single.count > 0).astype(np.int64), single.of), (base, single.of), (np.log10(known.p), known.of))]
            n = len(chunk.first)
            yield pa.record_batch(
                [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(chunk.size), pa.array(sums[0]), pa.array(np.full(n, n_train)), pa.array(sums[1]), pa.array(sums[2])],
                [x.split()[0] for x in SCORES.split(", ")],
            )

    model = tables[0]
    for t in tables[1:]:
        model = model.unionByName(t)
    scores = store(joined(held, answers).mapInArrow(score, SCORES), "katz-scores")
    for name in ("chunks", "answers"):
        spark.sql(f"drop table {name}_{made}")  # its files stay in the shared folder, as all tables do
    return scores, model, levels


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def joined(held: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Chunks with the answers that they have got; no more than a chunk's own."""
    if answers is None:
        return held.select("chunk", "held", "sizes", "words", "tokens")
    own = answers.groupBy("chunk").agg(F.collect_list(F.struct("level", "bucket", "words", "counts", "sums", "lower")).alias("answers"))
    return held.select("chunk", "docs", "held", "sizes", "words", "tokens").join(own.hint("shuffle_hash"), "chunk")
