"""Substring removal by a sparse suffix array with bucket-pointer refinement.

A byte goes if it lies in a string of `length` bytes that also starts anywhere else.
Starts of such strings are suffixes whose order would have to be known to `length` bytes;
only those that can matter are refined:

* Initial buckets.  Each start has an anchor, the place of the least q-gram fingerprint in
  its string.  Equal strings have equal anchors at equal distance, so the anchor's q-gram is
  the start's initial bucket.  Starts that share an anchor are neighbours and stay one
  block, which keeps the array sparse: about one block for 185 bytes of prose.
* Bucket pointers.  A block's identifier is the fingerprint (126 bits) of the bytes that its starts
  span.  Blocks with the same identifier hold the same strings at the same distances and
  are settled together: repeated if there are two or more, however many copies there are.
* Refinement.  Where an initial bucket holds different identifiers, its blocks are cut by
  distance into smaller ones and sorted into buckets again, by the identifier of the bytes
  that all their starts have in common, read at the later offset; what is left alone in
  its bucket is settled as unique.  One block of each identifier goes on, as identifiers
  already refined are used again for all its copies.  The last blocks hold one start.

Only block rows are shuffled and counted, with partial sums before the shuffle.  Identifiers
that are in very many blocks are known by a list of bounded size, and their blocks are marked
without a shuffle.  Texts are shuffled twice, by row: to read the bytes around unsettled
anchors, and to cut.

Null texts are empty.  Repeated rows repeat each other.  Matches never cross texts, and
texts shorter than `length` are left as they are.  An empty table gives an empty result.
Other columns of the input are not looked at, whatever their names; those to carry along
must not have a name of the result.  A text of any length is one chunk, in a task's memory
some forty times its size.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .tables import forget, map_batches, row_key, store

U = np.uint64
MOST_HOT = 100_000


@dataclass(frozen=True)
class Suffixes:
    length: int = 400
    q: int = 32
    steps: tuple[int, ...] = (64, 16, 4, 1)  # distances in a block at each refinement
    hot: int = 1000  # names in no more blocks than this are not hot, however few blocks there are

    @property
    def cuts(self) -> tuple[int, ...]:
        """The steps that leave starts of a part half their length in common at least."""
        return tuple(s for s in self.steps if 2 * s <= self.length)

    @property
    def span(self) -> int:
        """Distances that an anchor can have from a start."""
        return self.length - self.q + 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(prints: bt.Fingerprints, offsets: np.ndarray, how: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, anchor places, first and last start of the blocks of a chunk."""
    size = int(offsets[-1])
    none = (np.zeros(0, np.int64),) * 4
    if size < how.length:
        return none
    place = np.arange(size - how.q + 1)
    bits = U(32)  # of the place; as many are left to order q-grams by
    grams = prints.of(place, place + how.q)
    least = sliding_least((grams >> bits << bits) | place.astype(U), how.span)
    at = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    start = np.arange(len(at))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + how.length <= offsets[row + 1]
    start, at, row = start[inside], at[inside], row[inside]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], at[first], start[first], start[last]


def identifier(prints: bt.Fingerprints, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """The name of the bytes spanned by starts first to last, with their distances from the anchor."""
    name = prints.of(first, last + length)
    return bt.mix(name + bt.mix((anchor - first).astype(U) * U(65537) + (anchor - last).astype(U)))


ROW = "row bigint, own bigint"  # a row's key and its id, as keys alone are not unique for ever
PLACE = "anchor bigint, first bigint, last bigint"
BLOCKS = f"{ROW}, bucket bigint, name bigint, check bigint, {PLACE}"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def blocks(docs: DataFrame, how: Suffixes) -> DataFrame:
    """The blocks of all texts; places are bytes from the text's start."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        keys, own, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
        for base, data, offsets in bt.chunks(batch.column(2), 1 << 18):
            prints = bt.Fingerprints(data)
            row, at, first, last = anchors(prints, offsets, how)
            bucket, name = prints.of(at, at + how.q), identifier(prints, at, first, last, how.length)
            del prints
            check = bt.FieldPrints(data).of(first, last + how.length)
            begin = offsets[row]
            parts.append([keys[base + row], own[base + row], bucket.view(np.int64), name.view(np.int64), check.view(np.int64), at - begin, first - begin, last - begin])
        return pa.table([np.concatenate(x) for x in zip(*parts)], names_of(BLOCKS))

    return map_batches(docs, step, BLOCKS)


PIECES = f"{ROW}, {PLACE}, settled boolean, bucket bigint, name bigint, check bigint, bytes binary"


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges of data one after another, and where each begins."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets


def refine(held: dict[str, np.ndarray], data: np.ndarray, begin: np.ndarray, how: Suffixes, step: int) -> pa.Table:
    """Blocks, whose starts' bytes lie in data from begin on, in parts of step distances, with their buckets and names.

    A part ends where the distance from the anchor is a multiple of step.
    """
    anchor, first, last = held["anchor"], held["first"], held["last"]
    low, high = (anchor - last) // step, (anchor - first) // step
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - low, n)
    a, b = np.maximum(first[of], anchor[of] - k * step - step + 1), np.minimum(last[of], anchor[of] - k * step)
    to_data = (begin - first)[of]
    prints, fields = bt.Fingerprints(data), bt.FieldPrints(data)
    # what every start at these distances has in common, whether or not all of them are here
    core = prints.of(anchor[of] - k * step + to_data, anchor[of] - k * step - step + 1 + how.length + to_data)
    names = identifier(prints, anchor[of] + to_data, a + to_data, b + to_data, how.length)
    buckets = bt.mix(core + bt.mix(held["bucket"].view(U)[of] + k.astype(U) * U(1009)))
    check = fields.of(a + to_data, b + to_data + how.length)
    kept, offsets = gather(data, a + to_data, b + to_data + how.length)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept)])
    columns = [held["row"][of], held["own"][of], anchor[of], a, b, held["settled"][of], buckets.view(np.int64), names.view(np.int64), check.view(np.int64), raw.cast(pa.binary())]
    return pa.table(columns, names_of(PIECES))


HELD = ("row", "own", "anchor", "first", "last", "settled", "bucket")


def refine_again(batch: pa.RecordBatch, how: Suffixes, step: int) -> pa.Table:
    """Blocks that carry the bytes of their starts, in smaller parts."""
    held = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in HELD}
    _, data, begin = next(bt.chunks(batch.column("bytes"), 1 << 62), (0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    return refine(held, data, begin[:-1], how, step)


def mark(table: DataFrame, names: DataFrame, by: list[str], how: Suffixes, blocks: int) -> DataFrame:
    """row, own, first and last of the table's blocks whose name is there twice or more; names: by and n.

    Blocks of names that are in more than a hundred-thousandth of all blocks are marked where
    they lie, by a list of at most 100,000 such names, and joined with their neighbours: a
    passage that fills a third of all texts is dealt to no one task.  The others are joined.
    """
    limit = max(how.hot, blocks // MOST_HOT)
    hot = names.where(F.col("n") > limit).select(*by)
    listed = hot.limit(MOST_HOT + 1).toPandas()
    if len(listed) > MOST_HOT:
        raise ValueError(f"more than {MOST_HOT} names in over {limit} of {blocks} blocks: the count of blocks is wrong")
    some = names.where((F.col("n") > 1) & (F.col("n") <= limit)).select(*by)
    if listed.empty:
        return table.join(some, by, "left_semi").select("row", "own", "first", "last")
    rest = table.join(F.broadcast(hot), by, "left_anti").join(some, by, "left_semi").select("row", "own", "first", "last")
    keys = np.sort(np.rec.fromarrays([listed[c].to_numpy(np.int64) for c in by], names=by))

    def step(batch: pa.RecordBatch) -> pa.Table:
        own = np.rec.fromarrays([batch.column(c).to_numpy() for c in by], names=by)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        found = batch.filter(pa.array(keys[at] == own))
        row, key, first, last = (found.column(c).to_numpy() for c in ("row", "own", "first", "last"))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (first[1:] < first[:-1]) | (first[1:] > last[:-1] + how.length)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
        # starts in between are covered by the strings of both neighbours
        return pa.table([row[begin], key[begin], first[begin], last[end]], ["row", "own", "first", "last"])

    return rest.unionByName(map_batches(table.select("row", "own", "first", "last", *by), step, f"{ROW}, first bigint, last bigint", 1 << 16))


def repeated_spans(rows: DataFrame, how: Suffixes, used: list[DataFrame]) -> DataFrame:
    """row, own, first, last: starts of strings that start elsewhere too, or that such strings cover.

    used gets the tables from which they are read.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        used.append(store(df, name))
        return used[-1]

    name, where = ["name", "check"], ["row", "own", "anchor", "first", "last"]
    table = stored(blocks(rows, how), "blocks")
    total = table.count()
    names = table.groupBy(*name).agg(F.count("*").alias("n"), F.min("bucket").alias("bucket"), F.min(F.struct(*where)).alias("at"))
    names = stored(names, "names")
    found = [mark(table, names, name, how, total)]
    mixed = names.groupBy("bucket").agg(F.count("*").alias("names"), F.min("n").alias("least")).where("names > 1 and least = 1").select("bucket")
    open_ = names.join(mixed, "bucket", "left_semi").select("at.*", "bucket", (F.col("n") > 1).alias("settled"))

    around = open_.groupBy("row", "own").agg(F.collect_list(F.struct("anchor", "first", "last", "bucket", "settled")).alias("blocks"))

    def read(batch: pa.RecordBatch) -> pa.Table:
        texts, held = batch.column("text"), batch.column("blocks")
        lists = held.value_lengths().to_numpy()
        flat = held.flatten()
        of = np.repeat(np.arange(len(lists)), lists)
        out = []
        for base, data, offsets in bt.chunks(texts):  # blocks of a text overlap, so they may have more bytes than it
            own = np.flatnonzero((of >= base) & (of < base + len(offsets) - 1))
            for part in np.array_split(own, max(1, -(-len(own) // 512))):
                if len(part):
                    b = {n: flat.field(n).take(pa.array(part)).to_numpy(zero_copy_only=False) for n in ("anchor", "first", "last", "bucket", "settled")}
                    b |= {n: batch.column(n).to_numpy()[of[part]] for n in ("row", "own")}
                    begin = offsets[of[part] - base]
                    raw, at = gather(data, begin + b["first"], begin + b["last"] + how.length)
                    out.append(refine(b, raw, at[:-1], how, how.cuts[0]))
        return pa.concat_tables(out)

    level = map_batches(rows.join(around, ["row", "own"]), read, PIECES, 128)
    for step in (*how.cuts[1:], None):
        level = stored(level, "level")
        names = level.groupBy("bucket", *name).agg(F.count("*").alias("n"), F.max("settled").alias("settled"), F.min(F.struct(*where)).alias("at"))
        names = stored(names, "parts")
        found.append(mark(level.where("not settled"), names, ["bucket", *name], how, total))
        if step is None:
            break
        done = (F.col("n") > 1) | F.col("settled")
        mixed = names.groupBy("bucket").agg(F.count("*").alias("names"), F.min(done).alias("done")).where("names > 1 and not done").select("bucket")
        keep = names.join(mixed, "bucket", "left_semi").select("bucket", *name, "at.*", done.alias("done"))
        following = level.drop("settled").join(keep, [*where, "bucket", *name]).withColumnRenamed("done", "settled")
        level = map_batches(following.select(*HELD, "bytes"), lambda b, s=step: refine_again(b, how, s), PIECES, 256)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


CUTS = "doc_id bigint, row bigint, n_bytes bigint, n_removed bigint, n_repeated bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept_text string"


def merged(spans: list[dict], length: int) -> list[list[int]]:
    """Disjoint byte ranges covered by strings of length that begin at first to last."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"] + length) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The range without the characters of which it has a part only."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
        if raw[end] & 0xC0 != 0x80:
            break
    return start, end


def ranges_of(found: DataFrame, length: int) -> DataFrame:
    """row, own, and the disjoint byte ranges of the repeated strings of each row."""
    held = found.groupBy("row", "own").agg(F.collect_set(F.struct("first", "last")).alias("found"))

    def step(batch: pa.RecordBatch) -> pa.Table:
        ranges = [[{"start": a, "end": b} for a, b in merged(x, length)] for x in batch.column(2).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([batch.column(0), batch.column(1), pa.array(ranges, kind)], ["row", "own", "ranges"])

    return map_batches(held, step, f"{ROW}, ranges array<struct<start:bigint,end:bigint>>")


def repeated_within(rows: DataFrame, shorter: DataFrame, how: Suffixes, used: list[DataFrame]) -> DataFrame:
    """Like repeated_spans, looked for only in the ranges of repeated shorter strings: all that a long string consists of repeats with it."""
    place = F.xxhash64("own", "at.start")  # tells the ranges of a row apart
    ranges = shorter.select("row", "own", F.explode("ranges").alias("at")).where(F.col("at.end") - F.col("at.start") >= how.length).select("row", "own", place.alias("place"), "at.start", "at.end")
    ranges = store(ranges.distinct(), "ranges")
    per_row = ranges.groupBy("row", "own").agg(F.collect_list(F.struct("place", "start", "end")).alias("ranges"))

    def cut_out(batch: pa.RecordBatch) -> pa.Table:
        row, place, raw = [], [], []
        for key, text, held in zip(*(batch.column(n).to_pylist() for n in ("row", "text", "ranges"))):
            whole = text.encode()
            row += [key] * len(held)
            place += [x["place"] for x in held]
            raw += [whole[x["start"] : x["end"]] for x in held]
        return pa.table([pa.array(row, pa.int64()), pa.array(place, pa.int64()), pa.array(raw, pa.binary())], ["row", "own", "text"])

    parts = store(map_batches(rows.join(per_row, ["row", "own"]), cut_out, f"{ROW}, text binary", 64), "parts-of-texts")
    used.append(parts)
    found = repeated_spans(parts, how, used).withColumnRenamed("own", "place")
    return found.join(ranges, ["row", "place"]).select("row", "own", (F.col("first") + F.col("start")).alias("first"), (F.col("last") + F.col("start")).alias("last"))


def remove_repeats(docs: DataFrame, how: Suffixes = Suffixes(), doc: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), report: int | None = None) -> DataFrame:
    """For every row its removed byte ranges, the hash of the bytes kept, the text that is left, and columns to carry along.

    kept_text keeps a character of which a range covers only some bytes; the hash does not.
    With report, a shorter length, n_repeated is how many bytes lie in strings of that length
    that also start elsewhere: they are told of, and stay.  Without, it is n_removed.
    """
    ids = F.col(doc).cast("bigint")
    rows = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(-(2**63))).alias("own"), row_key(doc, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)
    texts, used = rows.select("row", "own", "text"), []
    if report:
        short = replace(how, length=report)
        shorter = store(ranges_of(repeated_spans(texts.where(F.octet_length("text") >= report), short, used), report), "shorter")
        forget(used)
        length = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
        spans = ranges_of(repeated_within(texts, shorter, how, used), how.length)
        spans = shorter.select("row", "own", length.alias("n_repeated")).join(spans, ["row", "own"], "left")
    else:
        spans = ranges_of(repeated_spans(texts.where(F.octet_length("text") >= how.length), how, used), how.length)
        spans = spans.withColumn("n_repeated", F.lit(None).cast("bigint"))
    spans = store(spans, "spans")
    forget(used)

    def step(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for doc_id, row, text, held, repeated in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row", "text", "ranges", "n_repeated"))):
            raw = text.encode()
            ranges = [(x["start"], x["end"]) for x in held or []]
            kept, chars, at, from_ = hashlib.sha256(), [], 0, 0
            for a, b in ranges:
                kept.update(raw[at:a])
                at = b
                x, y = whole_characters(raw, a, b)
                chars.append(raw[from_:x])
                from_ = y
            kept.update(raw[at:])
            chars.append(raw[from_:])
            gone = sum(b - a for a, b in ranges)
            out.append((doc_id, row, len(raw), gone, repeated or gone, len(ranges), [{"start": a, "end": b} for a, b in ranges], kept.hexdigest(), b"".join(chars).decode()))
        kinds = [pa.int64()] * 6 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
        names = ["doc_id", "row", "n_bytes", "n_removed", "n_repeated", "n_spans", "spans", "kept_sha256", "kept_text"]
        return pa.table([*(pa.array(list(c), k) for c, k in zip(zip(*out), kinds)), *map(batch.column, carry)], [*names, *carry])

    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(rows.join(spans, ["row", "own"], "left"), step, CUTS + carried)
