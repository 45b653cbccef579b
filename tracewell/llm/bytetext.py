"""Vectorised work on the UTF-8 bytes of many texts at once.

A chunk of texts is one byte array with offsets, as Arrow stores it.  Words are
found by the ASCII bytes that separate them, which is exact on UTF-8 because no
byte of a multi-byte character is below 0x80.  A word, n-gram or byte range is
known by a 64-bit fingerprint; where equal names alone decide, a second one over prime
fields is added to it, which makes 126 bits, as strings with equal sums modulo 2**64 can be made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Bytes that part words: [\x20\x09-\x0D], and everything ASCII but lower-case letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[0x00:0x30] = NON_ALNUM[0x3A:0x61] = NON_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits under which near values come to lie far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        have = _powers[name]
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[name] = have
    return _powers["up"], _powers["down"]


class Fingerprints:
    """Fingerprints of byte ranges of one chunk, each in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, end = np.asarray(start), np.asarray(end)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


LONG_WORD = 128


def word_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of words; long ones, of which some with equal sums can be made, by both kinds of sum."""
    out = Fingerprints(data).of(start, end)
    long = np.flatnonzero(np.asarray(end) - np.asarray(start) >= LONG_WORD)
    if len(long):
        out[long] = mix(out[long] ^ FieldPrints(data).of(start[long], end[long]))
    return out


PRIMES = (2**31 - 1, 2**31 - 19)
_fields = [np.random.default_rng(q).integers(1, q, 257).astype(np.uint64) for q in PRIMES]  # of the bytes, and the base
_field_powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in PRIMES]


def field_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both primes the powers of the base and of its inverse, n of each at least."""
    for k, (q, values) in enumerate(zip(PRIMES, _fields)):
        both = []
        for have, base in zip(_field_powers[k], (int(values[256]), pow(int(values[256]), -1, q))):
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), q)) % np.uint64(q)])
            both.append(have)
        _field_powers[k] = (both[0], both[1])
    return _field_powers


class FieldPrints:
    """Fingerprints of 62 bits over two prime fields, of byte ranges of one chunk."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.down = [], []
        for q, values, (up, down) in zip(PRIMES, _fields, field_powers(n + 1)):
            sums = np.zeros(n + 1, np.uint64)  # of up to 2**33 values below 2**31
            np.cumsum(values[data] * up[:n] % np.uint64(q), out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[start]) % np.uint64(q) * d[start] % np.uint64(q) for q, s, d in zip(PRIMES, self.sums, self.down))
        return (a << np.uint64(31)) | b


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, data, offsets) for runs of rows of about limit bytes, of texts or bytes; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if raw else pa.large_string()), b"" if raw else "")
    if not len(column):
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, in order."""
    inside = ~parts[data]
    if not inside.any():
        return (np.zeros(0, np.int64),) * 3
    full = offsets[1:] > offsets[:-1]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of runs of width words within a row, and the first word's place; shorter rows have none."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n] * np.uint64(2 * k + 3))
    same = rows[:n] == rows[width - 1 :]
    return out[same], np.flatnonzero(same)


def per_row(rows: np.ndarray, n_rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, n_rows) if weights is not None else np.bincount(rows, minlength=n_rows)
