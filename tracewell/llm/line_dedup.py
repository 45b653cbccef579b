"""Substring removal by line and sentence hashing.

Units are the lines of a text, whatever their length, and the sentences of its lines from
`min_chars` code points on.  A unit is normalised (lower case, runs of white space made one
space) and known by a digest of 128 bits.  Digests are grouped over all texts; the
occurrence with the least rank, which is document id, then the text's key, then place, is
kept, and the others are removed.  Lines without a word are no units.
That a unit comes again in its own text is seen where the text is cut, so a digest's group
needs no more than the least rank.

Only units, without their texts, are shuffled; counts and least ranks are aggregated before
the shuffle.  Digests in very many places are broadcast, as a list of bounded size, so that
a line that fills a third of all texts is dealt to no one task.

Null and empty texts have no units and stay as they are; an empty table gives an empty
result.  Rows without id rank last, among them by their texts' keys.  Repeated rows, with
equal id (or none) and equal text, are one document stored more than once: what stays in
one stays in all.  Other columns of the input are not looked at, whatever their names.
Spans are in code points of the original text.  A text is held whole by one task, with its units.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches, row_key, store


@dataclass(frozen=True)
class Units:
    min_chars: int = 40  # of a sentence that is not a whole line
    hot: int = 1000  # a digest in no more places than this is not hot, however few units there are
    sentence: str = r"[^\s.!?].*?(?:[.!?]+(?=\s|$)|$)"


MOST_HOT = 100_000
UNITS = "rank bigint, row bigint, start bigint, end bigint, digest binary, again boolean"


def cut(text: str, how: Units, sentence: re.Pattern) -> list[tuple[int, int, bytes, bool]]:
    """(start, end, digest, whether it came before) of the units of a text."""
    out, at, seen = [], 0, set()
    for line in text.split("\n"):
        ranges = [(0, len(line)), *(m.span() for m in sentence.finditer(line))]
        names = [" ".join(line[a:b].lower().split()) for a, b in ranges]
        for k, ((a, b), name) in enumerate(zip(ranges, names)):
            if name and (not k or (b - a >= how.min_chars and name != names[0])):  # a line of one sentence is one unit
                digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
                out.append((at + a, at + b, digest, digest in seen))
                seen.add(digest)
        at += len(line) + 1
    return out


def units(docs: DataFrame, how: Units) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.Table:
        sentence, out = re.compile(how.sentence), []
        for rank, row, text in zip(*(c.to_pylist() for c in batch.columns)):
            out += [(rank, row, *unit) for unit in cut(text or "", how, sentence)]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], ["rank", "row", "start", "end", "digest", "again"])

    return map_batches(docs, step, UNITS)


CUTS = "doc_id bigint, n_chars bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept_text string"


def remove_units(docs: DataFrame, how: Units = Units(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row the removed spans of the original text, the text that is left and its hash."""
    ids = F.col(doc).cast("bigint")
    rows = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(2**63 - 1)).alias("rank"), row_key(doc, text).alias("row"), F.col(text).alias("text"))
    table = store(units(rows.select("rank", "row", "text"), how), "units")
    own = F.struct("rank", "row")
    groups = table.groupBy("digest").agg(F.count("*").alias("n"), F.min(own).alias("first"), F.max(own).alias("other"))
    shared = store(groups.where("first <> other").select("digest", "n", "first"), "shared")
    limit = max(how.hot, table.count() // MOST_HOT)  # so there are at most MOST_HOT hot ones
    hot = F.broadcast(shared.where(F.col("n") > limit).select("digest", "first"))
    once = table.where("not again")
    seldom = once.join(hot.select("digest"), "digest", "left_anti").join(shared.where(F.col("n") <= limit).select("digest", "first"), "digest")
    later = table.where("again").select("rank", "row", "start", "end")
    for found in (once.join(hot, "digest"), seldom):
        later = later.unionByName(found.where(own != F.col("first")).select("rank", "row", "start", "end"))
    spans = later.groupBy("rank", "row").agg(F.collect_set(F.struct("start", "end")).alias("found"))

    def step(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for doc_id, text, found in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "found"))):
            text, ranges = text or "", []
            for a, b in sorted((s["start"], s["end"]) for s in found or []):
                if text[b : b + 1] == "\n" and (a == 0 or text[a - 1] == "\n"):
                    b += 1  # a whole line goes with its end
                if ranges and a <= ranges[-1][1]:
                    ranges[-1][1] = max(ranges[-1][1], b)
                else:
                    ranges.append([a, b])
            kept, at = [], 0
            for a, b in ranges:
                kept.append(text[at:a])
                at = b
            left = "".join(kept) + text[at:]
            out.append((doc_id, len(text), sum(b - a for a, b in ranges), len(ranges), [{"start": a, "end": b} for a, b in ranges], hashlib.sha256(left.encode()).hexdigest(), left))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in ("doc_id", "n_chars", "n_removed", "n_spans", "spans", "kept_sha256", "kept_text")])

    return map_batches(rows.join(spans, ["rank", "row"], "left"), step, CUTS)
