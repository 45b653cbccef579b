"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  The vector of a letter n-gram binds, by
multiplication, the vectors of its letters, each permuted by its place; a text's vector
bundles, by addition, those of its n-grams; a language's prototype bundles the texts of
the language.  A text goes to the language whose prototype has the greatest cosine.

Training adds up one vector per language and task, so the driver gets languages x
dimensions numbers however large the corpus.  Null texts, and those without a letter, are
`und` with score 0; so is every text where nothing was learned.  Ties go to the first
language in order.  Each row, repeated or not, is judged by its own text.  An empty table
gives an empty result.  Other columns of the input are not looked at, whatever their names.
A text of any length is one chunk of a task.  Vectors of n-grams are made for `block` of them
at a time, so that texts of many letters, such as Chinese, take memory by their length alone:
some 50 bytes for each byte of the texts that are bundled at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .tables import map_batches

UNKNOWN = "und"


@dataclass(frozen=True)
class Space:
    """n letters make an n-gram; letters of a word and one space between words count."""

    dimensions: int = 1024
    n: int = 3
    rows: int = 64  # texts whose vectors are bundled at once
    block: int = 16_384  # n-grams whose vectors are held at once


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(1 << 16)
def letter_vector(code: int, place: int, dimensions: int) -> np.ndarray:
    """A letter's random vector, permuted by its place in the n-gram; the same in every task."""
    bits = np.random.default_rng([code, 7919]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return np.roll(bits, place * 37 + place).astype(np.int8)


def ngram_vectors(codes: np.ndarray, space: Space) -> np.ndarray:
    """Vectors of the n-grams whose letters are the rows of codes."""
    letters, which = np.unique(codes, return_inverse=True)
    return bound(which.reshape(codes.shape), vectors_by_place(letters, space), space)


def vectors_by_place(letters: np.ndarray, space: Space) -> list[np.ndarray]:
    if not len(letters):
        return []
    first = np.stack([letter_vector(int(c), 0, space.dimensions) for c in letters])
    return [np.roll(first, place * 37 + place, axis=1) for place in range(space.n)]


def bound(which: np.ndarray, tables: list[np.ndarray], space: Space) -> np.ndarray:
    """Products of the vectors of n-grams' letters, given by their numbers in the tables."""
    out = np.ones((len(which), space.dimensions), np.int8)
    for place, table in enumerate(tables):
        out *= table[which[:, place]]
    return out


def ngrams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the distinct n-grams; text and n-gram of every place; which texts have a letter."""
    table, rows, code = letter_table(), [], []
    for at, data, offsets in bt.chunks(texts):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows.append(at + np.repeat(np.arange(len(offsets) - 1), np.diff(lead[offsets])))
        code.append(table[points])
    count = len(texts)
    rows, code = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, code))
    lettered = bt.per_row(rows[code > 0], count) > 0 if len(rows) else np.zeros(count, bool)
    letters = np.unique(code)
    index = np.searchsorted(letters, code).astype(np.int64)
    # runs of what is no letter become one space; every text begins and ends with one
    gap = code == 0
    first = np.ones(len(code), bool)
    first[1:] = rows[1:] != rows[:-1]
    keep = ~gap | ~np.concatenate([[False], gap[:-1]]) | first
    index, rows = index[keep], rows[keep]
    if len(index) < n:
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
    size, m = len(letters), len(index) - n + 1
    key = np.zeros(m, np.int64)
    for k in range(n):
        key = key * size + index[k : k + m]
    key = key[rows[:m] == rows[n - 1 :]]
    own = rows[:m][rows[:m] == rows[n - 1 :]]
    if size**n <= 1 << 22:
        present = np.flatnonzero(np.bincount(key, minlength=1))
        to = np.zeros(size**n, np.int64)
        to[present] = np.arange(len(present))
        which = to[key]
    else:
        present, which = np.unique(key, return_inverse=True)
    grams = np.stack([letters[present // size**k % size] for k in reversed(range(n))], 1) if len(present) else np.zeros((0, n), np.int64)
    return grams, own, which, lettered


def bundles(grams: np.ndarray, own: np.ndarray, which: np.ndarray, count: int, space: Space) -> np.ndarray:
    """The sums of the vectors of each text's n-grams, block by block; whole numbers."""
    out = np.zeros((count, space.dimensions))
    letters, numbers = np.unique(grams, return_inverse=True)
    numbers, tables = numbers.reshape(grams.shape), vectors_by_place(letters, space)
    if len(grams) > space.block:
        order = np.argsort(which, kind="stable")
        own, which = own[order], which[order]
    for a in range(0, len(grams), space.block):
        part = numbers[a : a + space.block]
        lo, hi = (0, len(own)) if len(grams) <= space.block else np.searchsorted(which, [a, a + space.block])
        counts = np.bincount(own[lo:hi] * len(part) + (which[lo:hi] - a), minlength=count * len(part)).reshape(count, len(part))
        out += counts.astype(np.float32) @ bound(part, tables, space).astype(np.float32)
    return out


def learn(docs: DataFrame, space: Space = Space(), text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of the languages, from the rows with a text and a label.

    The number of languages must be small, as labels of languages are: they, not rows, reach the driver.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, space.rows):
                part = batch.slice(at, space.rows)
                grams, own, which, _ = ngrams(part.column(0), space.n)
                names, of = np.unique(np.array(part.column(1).to_pylist()), return_inverse=True)
                vectors = bundles(grams, of[own], which, len(names), space)
                for name, v in zip(names.tolist(), vectors):
                    sums[name] = sums.get(name, 0) + v.astype(np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["label", "vector"])

    parts = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, label).mapInArrow(bundle, "label string, vector array<bigint>")
    sums = parts.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions
        out.setdefault(r["label"], np.zeros(space.dimensions))[r["i"]] = r["x"]
    return dict(sorted(out.items()))


SCHEMA = "doc_id bigint, lang_pred string, score double"


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], space: Space = Space(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The likeliest language of every text; the score is its cosine, from 0 to 1."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-9) for x in names]).astype(np.float32) if names else None

    def step(batch: pa.RecordBatch) -> pa.Table:
        langs, scores = [], []
        for at in range(0, batch.num_rows, space.rows):
            grams, own, which, lettered = ngrams(batch.column(1).slice(at, space.rows), space.n)
            if matrix is None:
                langs += [UNKNOWN] * len(lettered)
                scores += [0.0] * len(lettered)
                continue
            vectors = bundles(grams, own, which, len(lettered), space)
            cosine = (vectors @ matrix.T) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            best = cosine.argmax(1)
            langs += [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores += np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0).tolist()
        return pa.table([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.selectExpr(f"cast({doc} as bigint) doc_id", text), step, SCHEMA)
