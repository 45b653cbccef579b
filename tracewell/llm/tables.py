"""Keys of rows and maps over document batches; tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, shared_folder, shuffles_dropped, store

__all__ = ["forget", "held_out", "map_batches", "row_key", "shared_folder", "shuffles_dropped", "store"]

#: Slice of a text column that one step of a task works on.
TEXT, DOC = "text", "doc_id"


def row_key(doc: str = DOC, text: str = TEXT):
    """A key of a row that every scan computes alike; rows with equal id and text share it, null ids too."""
    return F.xxhash64(F.col(doc), F.col(text))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, at_once: int = 512) -> DataFrame:
    """step over Arrow batches; step gets no more than so many rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                out = step(batch.slice(at, at_once))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def held_out(modulus: int, remainder: int, doc: str = DOC):
    """Whether crc32 of the id as text leaves remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder
