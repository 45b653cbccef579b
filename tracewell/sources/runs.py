"""Run folders: which component left which files, and what is in their archives."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import store
from . import ranges
from .ranges import opened

#: What follows a vendor's name in component folders, the first that fits counting, and roles of another name.
ROLES = ("cu-cp", "cu-up", "cu", "du", "gnb", "odu", "ocu", "ue", "5gc", "mme")
ROLE_NAMES = {"mme": "5gc"}
#: Logs, configurations and captures of each family of roles, the preferred first;
#: a configuration may have a vendor's name and an underscore before it.
RADIO_LOGS = ("gnb.log", "du.log", "cu.log", "cu_cp.log", "cu_up.log")
RADIO_CONFIGS = ("gnb.yml", "du.yml", "cu.yml")
CAPTURES = ("ngap.pcap", "f1ap.pcap", "e1ap.pcap", "mac.pcap", "rlc.pcap")
DEVICE_LOGS, DEVICE_CONFIGS = ("ue.log",), ("ue.cfg",)
CORE_LOGS, CORE_CONFIGS = ("mme.log", "amf.log", "open5gs.log"), ("mme.cfg", "amf.cfg")
RUN_NAME = r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size and time of all files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def role(component: Column) -> Column:
    """The role of a component's folder, such as gnb of vendor-gnb-0, or null."""
    after = F.when(component.rlike("^[A-Za-z0-9]+-"), F.regexp_replace(component, "^[A-Za-z0-9]+-", ""))
    return F.coalesce(*(F.when(after.startswith(name), ROLE_NAMES.get(name, name)) for name in ROLES))


def without_vendor(name: Column) -> Column:
    """A configuration's name without the vendor's before it."""
    return F.regexp_replace(name, r"^[A-Za-z0-9]+_(?=[a-z]+\.(?:yml|cfg)$)", "")


def parts(files: DataFrame, path: str = "path") -> DataFrame:
    """component, run and name of files at .../component/run/name or .../component/name; run is null in the latter."""
    pieces = F.split(path, "/")
    up = F.try_element_at(pieces, F.lit(-2))
    dated = up.rlike(RUN_NAME)
    return files.withColumn("name", F.element_at(pieces, -1)).withColumn("run", F.when(dated, up)).withColumn("component", F.when(dated, F.try_element_at(pieces, F.lit(-3))).otherwise(up))


def latest_path(files: DataFrame, key: list[str], name: str, path: str = "path") -> DataFrame:
    """For each key the last path, by name, that ends in a file's name."""
    held = files.where(F.element_at(F.split(path, "/"), -1) == name)
    return held.groupBy(*key).agg(F.max(path).alias(path))


def inventory(files: DataFrame, key: list[str] = ()) -> DataFrame:
    """What the latest run of each component left: role, run, logs, configs, captures (in order of preference) and metrics.

    files has key, component, run and name, as parts gives them.  A component's latest run is
    the one with the greatest name; files outside runs count where it has none.
    """
    by = [*key, "component"]
    latest = files.groupBy(*by).agg(F.max("run").alias("latest"))
    own = files.join(latest, by).where(F.col("run").eqNullSafe(F.col("latest")))
    held = own.groupBy(*by).agg(F.max("run").alias("run"), F.array_sort(F.collect_set(F.when(without_vendor(F.col("name")).isin(*_KNOWN), F.col("name")))).alias("names"))
    kind = role(F.col("component"))

    def found(radio: tuple, device: tuple, core: tuple) -> Column:
        def present(names: tuple) -> Column:
            def like(wanted: str) -> Column:
                return F.filter("names", lambda own: without_vendor(own) == wanted)

            return F.concat(*map(like, names)) if names else F.expr("cast(array() as array<string>)")

        return F.when(kind == "ue", present(device)).when(kind == "5gc", present(core)).when(kind.isNotNull(), present(radio)).otherwise(F.expr("cast(array() as array<string>)"))

    return held.select(
        *by, kind.alias("role"), "run", found(RADIO_LOGS, DEVICE_LOGS, CORE_LOGS).alias("logs"), found(RADIO_CONFIGS, DEVICE_CONFIGS, CORE_CONFIGS).alias("configs"), found(CAPTURES, (), ()).alias("captures"),
        F.array_contains("names", "metrics.json").alias("metrics"),
    )


_KNOWN = (*RADIO_LOGS, *RADIO_CONFIGS, *CAPTURES, *DEVICE_LOGS, *DEVICE_CONFIGS, *CORE_LOGS, *CORE_CONFIGS, "metrics.json")


def capture_folders(files: DataFrame, least: int = 2, path: str = "path") -> DataFrame:
    """Folders with at least so many of the known captures, and which."""
    name = F.element_at(F.split(path, "/"), -1)
    held = files.where(name.isin(*CAPTURES)).groupBy(F.regexp_replace(path, "/[^/]*$", "").alias("folder")).agg(F.array_sort(F.collect_set(name)).alias("captures"))
    return held.where(F.size("captures") >= least)


def with_addresses(components: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Components with the address, and the least and greatest port, of the nodes of their role.

    A testbed's nodes are a few rows; many nodes of one role become one range of ports.
    """
    ranges = nodes.withColumn("role", F.regexp_extract("name", r"^([A-Za-z]+|5gc)", 1)).groupBy(*key, "role").agg(
        F.count("*").alias("nodes"), F.min("address").alias("address"), F.min("port").alias("port_from"), F.max("port").alias("port_to")
    )
    return components.join(ranges, [*key, "role"], "left")


def archive_entries(archives: DataFrame, pattern: str, content: str = "content", path: str = "path") -> DataFrame:
    """path, entry and text of the zip entries whose names match a pattern; bad bytes are replaced, bad archives have none.

    An archive is read by one task; its size is bounded by what a binary value can hold (2 GB).
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = re.compile(pattern)
        for frame in frames:
            for name, raw in zip(frame[path], frame[content]):
                if raw is None or not zipfile.is_zipfile(io.BytesIO(raw)):
                    continue
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for entry in z.namelist():
                        if not entry.endswith("/") and wanted.search(entry):
                            yield pd.DataFrame({"path": [name], "entry": [entry], "text": [z.read(entry).decode("utf-8", "replace")]})

    return archives.select(path, content).mapInPandas(read, "path string, entry string, text string")


PARTS = "path string, entry string, part bigint, text string, error string"


def entry_parts(spark: SparkSession, path: str, pattern: str, size: int = 8 << 20, glob: str = "*.zip") -> DataFrame:
    """The text of archives' entries whose names match, in parts of whole lines: path, entry, part (from 0), text and error.

    One task an archive reads its list of entries; the entries, of all archives, are then dealt
    to tasks, and each is inflated as a stream, so that neither an archive nor an entry is ever
    held whole.  Parts are of about so many bytes, and end with a line where one ends.  Entries
    that are encrypted, and what cannot be read of a damaged one, are told in `error`; files
    that are no archives have no entries.  Bad bytes are replaced.
    """
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(pattern)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as file:
                    try:
                        found = [x.filename for x in archive(file).infolist() if not x.is_dir() and wanted.search(x.filename)]
                    except zipfile.BadZipFile:
                        found = []
                yield pa.record_batch([pa.array([name] * len(found), pa.string()), pa.array(found, pa.string())], ["path", "entry"])

    entries = store(ranges.listed(spark, path, glob).select("path").repartition("path").mapInArrow(plan, "path string, entry string"), "archive-entries")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "entry": pa.string(), "part": pa.int64(), "text": pa.string(), "error": pa.string()}
        for batch in batches:
            for name, entry in zip(*(batch.column(n).to_pylist() for n in ("path", "entry"))):
                with opened(name) as file:
                    for part, (text, error) in enumerate(inflated(archive(file), entry, size)):
                        yield pa.record_batch([pa.array([x], k) for x, k in zip((name, entry, part, text, error), kinds.values())], list(kinds))

    return entries.repartition("path", "entry").mapInArrow(read, PARTS)


def archive(file) -> zipfile.ZipFile:
    file.seek(0)
    return zipfile.ZipFile(file)


def inflated(held: zipfile.ZipFile, entry: str, size: int) -> Iterator[tuple[str | None, str | None]]:
    """Parts of an entry's text, and at last what went wrong."""
    if held.getinfo(entry).flag_bits & 1:
        yield None, "encrypted"
        return
    decode, rest, error = codecs.getincrementaldecoder("utf-8")("replace").decode, "", None
    try:
        with held.open(entry) as stream:
            while data := stream.read(size):
                whole, _, tail = (rest + decode(data)).rpartition("\n")
                if whole or len(tail) >= size:
                    yield (f"{whole}\n", None) if whole else (tail, None)
                rest = tail if whole or len(tail) < size else ""
        rest += decode(b"", True)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as e:
        error = f"{type(e).__name__}: {e}"
    if rest or error:
        yield rest or None, error
