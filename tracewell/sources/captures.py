"""Packet captures: frames of capture files, and tables of extracted fields."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..shared import store
from . import ranges
from .ranges import Window, opened

#: Names of procedure codes.
PROCEDURES = (
    ("ngap", 0, "AMFConfigurationUpdate"),
    ("ngap", 1, "RANConfigurationUpdate"),
    ("ngap", 4, "DownlinkNASTransport"),
    ("ngap", 14, "InitialContextSetup"),
    ("ngap", 15, "InitialUEMessage"),
    ("ngap", 16, "NASNonDeliveryIndication"),
    ("ngap", 21, "NGSetup"),
    ("ngap", 27, "Paging"),
    ("ngap", 29, "PDUSessionResourceSetup"),
    ("ngap", 36, "UEContextModification"),
    ("ngap", 41, "UEContextRelease"),
    ("ngap", 44, "UERadioCapabilityInfoIndication"),
    ("ngap", 46, "UplinkNASTransport"),
    ("f1ap", 1, "F1Setup"),
    ("f1ap", 5, "UEContextSetup"),
    ("f1ap", 6, "UEContextRelease"),
    ("f1ap", 7, "UEContextModification"),
    ("f1ap", 11, "InitialULRRCMessageTransfer"),
    ("f1ap", 12, "DLRRCMessageTransfer"),
    ("f1ap", 13, "ULRRCMessageTransfer"),
    ("e1ap", 3, "gNB-CU-UP-E1Setup"),
    ("e1ap", 4, "gNB-CU-CP-E1Setup"),
    ("e1ap", 5, "gNB-CU-UP-ConfigurationUpdate"),
    ("e1ap", 6, "gNB-CU-CP-ConfigurationUpdate"),
    ("e1ap", 7, "E1Release"),
    ("e1ap", 8, "bearerContextSetup"),
    ("e1ap", 9, "bearerContextModification"),
    ("e1ap", 10, "bearerContextModificationRequired"),
    ("e1ap", 11, "bearerContextRelease"),
    ("e1ap", 12, "bearerContextReleaseRequest"),
)
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\xc3\xd4": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1)}
EXPORTED_PDU, DISSECTOR_NAME = 252, 12
FRAMES = "path string, frame bigint, nanos bigint, captured bigint, length bigint, link int, dissector string"


def dissector(data: bytes) -> str | None:
    """The name that an exported PDU's tags give for what it holds."""
    at = 0
    while at + 4 <= len(data):
        tag, size = struct.unpack_from(">HH", data, at)
        if tag == 0:
            return None
        if tag == DISSECTOR_NAME:
            return data[at + 4 : at + 4 + size].rstrip(b"\0").decode("ascii", "replace")
        at += 4 + size
    return None


def frames_of(raw: bytes) -> Iterator[tuple]:
    """frame, nanos, captured, length, link and dissector of the whole frames of a capture; of other bytes none."""
    if raw is None or len(raw) < 24 or raw[:4] not in MAGIC:
        return
    order, unit = MAGIC[raw[:4]]
    link, at, frame = struct.unpack_from(order + "I", raw, 20)[0] & 0xFFFF, 24, 0
    while at + 16 <= len(raw):
        sec, part, captured, length = struct.unpack_from(order + "IIII", raw, at)
        if at + 16 + captured > len(raw):
            return
        frame += 1
        yield frame, sec * 10**9 + part * unit, captured, length, link, dissector(raw[at + 16 : at + 16 + captured]) if link == EXPORTED_PDU else None
        at += 16 + captured


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of capture files of up to 2 GB, one task a file; a frame that was cut off ends its file."""
    return frames_in(spark.read.format("binaryFile").load(path))


def frames_in(files: DataFrame, batch: int = 100_000) -> DataFrame:
    """The frames of captures that are held as rows of path and content."""

    def read(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for name, raw in zip(table["path"], table["content"]):
                yield from batches(((name, *row) for row in frames_of(raw)), batch)

    return files.select("path", "content").mapInPandas(read, FRAMES)


def batches(rows: Iterator[tuple], size: int) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FRAMES.split(", ")]
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=names)


def frames_by_range(spark: SparkSession, path: str, size: int = 64 << 20, since: int | None = None, until: int | None = None, pattern: str = "*") -> DataFrame:
    """The frames of capture files of any size, several tasks a file; since and until bound their nanos, the second exclusively.

    Captures have no marks at which to split them, so one task a file first goes from header to
    header, without what the frames hold, and notes every so many bytes where a frame begins
    and which one it is.  The parts between are then read by a task each; parts whose times are
    all out of bounds are not.
    """
    low, high = -(2**63) if since is None else since, 2**63 - 1 if until is None else until

    def plan(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for name in table["path"]:
                with opened(name) as file:
                    parts = [(name, *part) for part in capture_parts(Window(file), size)]
                yield pd.DataFrame(parts, columns=["path", "start", "end", "frame", "first", "last"])

    parts = ranges.listed(spark, path, pattern).select("path").repartition("path").mapInPandas(plan, "path string, start bigint, end bigint, frame bigint, first bigint, last bigint")
    parts = store(parts, "capture-parts").where((F.col("last") >= low) & (F.col("first") < high)).drop("first", "last")

    def read(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for name, start, end, frame in table.itertuples(index=False):
                with opened(name) as file:
                    window = Window(file)
                    rows = ((name, *row) for row in capture_frames(window, window.read(0, 24), start, end, frame) if low <= row[1] < high)
                    yield from batches(rows, 100_000)

    return parts.repartition("path", "start").mapInPandas(read, FRAMES)


def capture_headers(window: Window, head: bytes, at: int, end: int) -> Iterator[tuple]:
    """at, nanos, captured and length of the whole frames from a place on."""
    order, unit = MAGIC[head[:4]]
    while at < end and len(raw := window.read(at, 16)) == 16:
        sec, part, captured, length = struct.unpack(order + "IIII", raw)
        if at + 16 + captured > window.length:
            return
        yield at, sec * 10**9 + part * unit, captured, length
        at += 16 + captured


def capture_parts(window: Window, size: int) -> Iterator[tuple]:
    """start, end, the number of the first frame, and the least and greatest time, of parts of about so many bytes."""
    head = window.read(0, 24)
    if len(head) < 24 or head[:4] not in MAGIC:
        return
    start, number, times = 24, 1, []
    frame = 0
    for at, nanos, captured, _ in capture_headers(window, head, 24, window.length):
        frame += 1
        times = [min(times[0], nanos), max(times[1], nanos)] if times else [nanos, nanos]
        if (end := at + 16 + captured) - start >= size:
            yield start, end, number, *times
            start, number, times = end, frame + 1, []
    if times:
        yield start, end, number, *times


def capture_frames(window: Window, head: bytes, start: int, end: int, frame: int) -> Iterator[tuple]:
    """What frames_of gives, for a part of a capture."""
    link = struct.unpack_from(MAGIC[head[:4]][0] + "I", head, 20)[0] & 0xFFFF
    for frame, (at, nanos, captured, length) in enumerate(capture_headers(window, head, start, end), frame):
        yield frame, nanos, captured, length, link, dissector(window.read(at + 16, captured)) if link == EXPORTED_PDU else None


def fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Tab-separated fields of frames; rows are cut or filled to the names, and carry their file."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("file"))


def typed(frame: DataFrame, epoch: str = "epoch", whole: tuple[str, ...] = ()) -> DataFrame:
    """Empty fields as null, t in microseconds, whole numbers as such; rows without an epoch go."""
    strings = [f.name for f in frame.schema if f.dataType.simpleString() == "string"]
    clean = frame.select(*(F.nullif(F.trim(n), F.lit("")).alias(n) if n in strings else F.col(n) for n in frame.columns))
    t = F.round(F.col(epoch).try_cast("decimal(20,9)") * 1_000_000).cast("bigint")
    return clean.withColumn("t", t).where("t is not null").select("t", *(F.expr(f"try_cast(`{n}` as bigint)").alias(n) if n in whole else F.col(n) for n in frame.columns if n != epoch))


def procedure_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROCEDURES), "proto string, code bigint, procedure string")


def named(frame: DataFrame, proto: str = "proto", code: str = "code") -> DataFrame:
    """procedure: a code's name, proc-N for an unknown one and ? for none."""
    known = procedure_table(frame.sparkSession).withColumnsRenamed({"proto": "_proto", "code": "_code"})
    joined = frame.join(F.broadcast(known), (F.col(proto) == F.col("_proto")) & (F.col(code) == F.col("_code")), "left")  # 30 rows
    name = F.when(F.col(code).isNull(), "?").otherwise(F.coalesce("procedure", F.concat(F.lit("proc-"), F.col(code).cast("string"))))
    return joined.withColumn("procedure", name).drop("_proto", "_code")


def direction(code: Column) -> Column:
    return F.when(code == "0", "UL").when(code == "1", "DL").otherwise(F.coalesce(code, F.lit("?")))


def event_summary(proto: Column, *fields: Column) -> Column:
    """One line on an event: its procedure code, or its radio identity and direction or bearer."""
    first, second, third = (*fields, *([F.lit(None).cast("string")] * 3))[:3]
    held = lambda c, other: F.coalesce(c, F.lit(other))
    return (
        F.when(proto.isin("ngap", "f1ap", "e1ap"), F.concat(F.lit("procCode="), held(first, "")))
        .when(proto == "mac", F.concat(F.lit("rnti="), held(first, "-"), F.lit(" dir="), direction(second)))
        .when(proto == "rlc", F.concat(F.lit("ueid="), held(first, "-"), F.lit(" bearer="), held(second, "?"), F.lit("/"), held(third, "?")))
        .otherwise("")
    )


def of_entity(frame: DataFrame, entity: str, ids: str = "ue_ids", summary: str = "summary") -> DataFrame:
    """Events with an id among theirs, or with it as the radio identity that their summary names."""
    tokens = F.split(summary, " ")
    radio = F.array_contains(tokens, f"rnti={entity}") | F.array_contains(tokens, f"ueid={entity}")
    return frame.where(F.coalesce(F.array_contains(ids, entity), F.lit(False)) | F.coalesce(radio, F.lit(False)))


def radio_identity(column: Column) -> Column:
    """An identity written as hexadecimal with 0x, or as a decimal number, as an integer."""
    return F.when(column.rlike("^0[xX]"), fn.hex_id(column)).otherwise(column.try_cast("bigint"))


def rlc_kind(data: Column, polling: Column) -> Column:
    """Whether a radio-link PDU is a status report, or data that asks for one, from its data/control and polling bits ('0' or '1')."""
    return F.when(data == "0", "status").when((data == "1") & (polling == "1"), "data, polled").when(data == "1", "data")


def random_access_response(rapid: Column) -> Column:
    """Whether a frame is an answer to a preamble: it names one."""
    return rapid.isNotNull() & (rapid != "")
