"""Quality rules: word statistics and compression bands.

A text is compressed whole and in fixed chunks with zstandard.  The ratio of its size to
the compressed size must lie in a band that depends on the text's length: above it a text
repeats itself, below it is noise.  Nothing is shuffled.

Null and empty texts have no words and fail the base rule.  Each row is judged by its own
text, so ties and repeated rows get equal results; columns other than id and text are not
read.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import bytetext as bt
from .tables import map_batches

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


@dataclass(frozen=True)
class Bands:
    """Limits by size in bytes: (up to, least ratio, greatest ratio); the last holds for all longer texts."""

    whole: tuple = ((64, 0.2, 2.0), (256, 0.7, 2.5), (1024, 1.1, 2.8), (4096, 1.25, 3.2), (16384, 1.3, 3.6), (None, 1.3, 4.2))
    chunk_bytes: int = 2048
    chunk: tuple = (1.15, 3.2)
    bad_chunks: float = 0.25  # greatest share of chunks outside their band
    level: int = 3
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5

    def within(self, size: int, ratio: float, chunks: list[float]) -> bool:
        low, high = next((lo, hi) for to, lo, hi in self.whole if to is None or size < to)
        bad = sum(not self.chunk[0] <= x <= self.chunk[1] for x in chunks)
        return low <= ratio <= high and bad <= self.bad_chunks * len(chunks)


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " ratio double, chunk_low double, chunk_high double, base_failed boolean, kept boolean"
)


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each key occurs again in its row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each key equals an earlier one of its row."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][(k[1:] == k[:-1]) & (r[1:] == r[:-1])]] = True
    return out


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines; every row has one at least."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    n = len(offsets) - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    start_rows, end_rows = np.concatenate([np.arange(n), rows]), np.concatenate([rows, np.arange(n)])
    a, b = np.lexsort((start, start_rows)), np.lexsort((end, end_rows))
    return start[a], end[b], start_rows[a]


def measures(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The base columns of the texts of a chunk."""
    n = len(offsets) - 1
    start, end, rows = bt.words(data, offsets, bt.SPACE)
    prints = bt.Fingerprints(data)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    shingles, first = bt.windows(prints.of(start, end), rows, n, window)
    again = first[repeated(shingles, rows[first])]
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + window, -1)
    from_, to, line_rows = lines(data, offsets)
    worded = np.concatenate([[0], np.cumsum(~bt.SPACE[data])])
    full = worded[to] > worded[from_]
    dup = later(prints.of(from_[full], to[full]), line_rows[full])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    return {
        "n_words": bt.per_row(rows, n),
        "word_chars": bt.per_row(rows, n, (lead[end] - lead[start]).astype(float)).astype(np.int64),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": bt.per_row(line_rows[full][dup], n),
        "n_repeat_words": bt.per_row(rows[np.cumsum(covered[:-1]) > 0], n) if len(start) else np.zeros(n, np.int64),
    }


def quality_rules(docs: DataFrame, bands: Bands = Bands(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict for every text."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        packer, parts = zstandard.ZstdCompressor(level=bands.level), []
        for _, data, offsets in bt.chunks(batch.column(1)):
            cols = measures(data, offsets, bands.window)
            raw, kept, ratios, lows, highs = memoryview(data), [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                ratio = (b - a) / len(packer.compress(raw[a:b])) if b > a else 0.0
                k = bands.chunk_bytes
                starts = [*range(a, b - k + 1, k), *([b - k] if b - a > k and (b - a) % k else [])]  # the last ends with the text
                each = [k / len(packer.compress(raw[i : i + k])) for i in starts]
                kept.append(bands.within(b - a, ratio, each))
                ratios.append(ratio)
                lows.append(min(each, default=None))
                highs.append(max(each, default=None))
            failed = (cols["n_words"] < bands.min_words) | (100 * cols["n_repeat_words"] > bands.repeat_percent * cols["n_words"])
            parts.append([*(pa.array(x, pa.int64()) for x in cols.values()), *(pa.array(x, pa.float64()) for x in (ratios, lows, highs)), pa.array(failed), pa.array(np.array(kept) & ~failed)])
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = [pa.chunked_array(list(x)).combine_chunks() for x in zip(*parts)]
        return pa.table([batch.column(0), *columns], names)

    return map_batches(docs.selectExpr(f"cast({doc} as bigint) doc_id", text), step, SCHEMA)
