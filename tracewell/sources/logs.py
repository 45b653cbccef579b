"""Text logs, configurations and metrics as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import running

#: How the lines of the two kinds of log begin.
RADIO_HEADER = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}) \[([A-Z][A-Z0-9_ -]*?)\s*\] \[([A-Z])\] (.*)"
DEVICE_HEADER = r"^(\d\d:\d\d:\d\d\.\d{3}) \[(\w+)\] (\S+)\s+(.*)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, part, ord and value of the lines of text files; part and ord give their order in a file.

    Large files are read in splits; a split's start orders it within its file.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    return read.select("file", "part", F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"\r$", "").alias("value"))


def radio_fields(value: Column) -> list[Column]:
    """ts, layer, level and message of a radio-node log line, and the identifiers in it."""
    def part(k: int) -> Column:
        return F.regexp_extract(value, RADIO_HEADER, k)

    def token(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(part(4), pattern, 1), F.lit(""))

    return [
        part(1).alias("ts"), part(2).alias("layer"), part(3).alias("level"), part(4).alias("message"),
        token(r"\bue=(\d+)").alias("ue"), token(r"\bpci=(\d+)").alias("pci"), token(r"c-rnti=(0x[0-9a-f]+)").alias("rnti"),
    ]


def parse_radio(frame: DataFrame, value: str = "value") -> DataFrame:
    """The timestamped lines of a radio-node log, parsed; a cheap test of the first digit goes before the pattern."""
    return frame.where(F.col(value).rlike("^[0-9]") & F.col(value).rlike(RADIO_HEADER)).select("*", *radio_fields(F.col(value)))


def parse_device(frame: DataFrame, value: str = "value") -> DataFrame:
    """The timestamped lines of a device-simulator log, parsed."""
    names = ("time", "layer", "direction", "message")
    return frame.where(F.col(value).rlike(DEVICE_HEADER)).select("*", *(F.regexp_extract(value, DEVICE_HEADER, k + 1).alias(n) for k, n in enumerate(names)))


def device_places(value: Column) -> list[Column]:
    """direction, ue and cell of a device's line by their places: the words after the first bracket; null where there are fewer."""
    words = F.split(F.trim(F.regexp_extract(value, r"^[^\]]*\]\s*(.*)$", 1)), r"\s+")
    return [F.nullif(F.get(words, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(("direction", "ue", "cell"))]


def metrics_text(message: Column) -> list[Column]:
    """fields, a map of the name=value pairs of a metrics line, and events, the entries of its list of events."""
    listed = F.regexp_extract(message, r"events=\[(.*?)\]", 1)
    pairs = r"([A-Za-z_]\w*)=([^\s\[\]{},]+)"
    bare = F.regexp_replace(message, r"events=\[.*?\]", "")
    found = F.arrays_zip(F.regexp_extract_all(bare, F.lit(pairs), F.lit(1)).alias("k"), F.regexp_extract_all(bare, F.lit(pairs), F.lit(2)).alias("v"))
    none = F.array().cast("array<struct<k:string,v:string>>")
    once = F.aggregate(found, none, lambda held, x: F.concat(F.filter(held, lambda y: y["k"] != x["k"]), F.array(x)))  # the last of a name wins
    return [F.map_from_entries(once).alias("fields"), F.regexp_extract_all(listed, F.lit(r"\{([^}]*)\}"), F.lit(1)).alias("events")]


def blocks(texts: DataFrame, key: list[str], text: str, header: str, drop: str | None = None) -> DataFrame:
    """Blocks of whole texts: a line that matches header and those up to the next one.

    Empty lines, lines that match drop, and lines before the first header, are dropped.  Returns key, block (from 0),
    head, body (an array of lines) and n_lines.
    """
    kept = lambda x: (x != "") & ~x.rlike(drop) if drop else x != ""
    every = texts.select(*key, F.filter(F.split(text, r"\r\n|\n|\r"), kept).alias("lines"))
    starts = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(header), i)))
    every = every.withColumn("starts", starts).where(F.size("starts") > 0)
    every = every.select("*", F.posexplode("starts").alias("block", "at"))
    end = F.coalesce(F.try_element_at("starts", F.col("block") + 2), F.size("lines"))
    return every.select(
        *key, "block", F.element_at("lines", F.col("at") + 1).alias("head"), F.slice("lines", F.col("at") + 2, end - F.col("at") - 1).alias("body"), (end - F.col("at")).cast("bigint").alias("n_lines")
    )


def blocks_of_lines(frame: DataFrame, file: list[str], order: list[str], header: str, value: str = "value") -> DataFrame:
    """The lines of large files with the number of their block, from 0; those before the first header are dropped.

    A file's lines are numbered by as many tasks as there are ranges of them.
    """
    numbered = running(frame.where(F.col(value) != ""), file, order, {"block": F.col(value).rlike(header).cast("bigint")})
    return numbered.withColumn("block", F.col("block") - 1).where("block >= 0")


def body_within(frame: DataFrame, file: list[str], line: str, header: Column, body: Column, span: int = 200) -> DataFrame:
    """Header lines with the first line after them, no more than span lines on, whose text meets `body`: its number as body_line, or null.

    Lines are dealt by file and number in buckets as wide as the span; a header looks into its
    own and the next one, so that it does not matter where a file is split.
    """
    bucket, who = F.floor(F.col(line) / span), F.struct(*file, F.col(line).alias("_from")).alias("_who")  # structs of nulls are equal
    place = lambda n: F.struct(*file, n.alias("_bucket")).alias("_place")
    heads = frame.where(header)
    asked = heads.select(who, F.explode(F.array(bucket, bucket + 1)).alias("_at"), *file).select("_who", place(F.col("_at")))
    held = frame.where(body).groupBy(place(bucket)).agg(F.array_sort(F.collect_list(line)).alias("_lines"))  # a span's lines at most
    after = F.filter("_lines", lambda x: (x > F.col("_who._from")) & (x <= F.col("_who._from") + span))
    first = asked.join(held, "_place").groupBy("_who").agg(F.min(F.array_min(after)).alias("body_line"))
    return heads.withColumn("_who", who).join(first, "_who", "left").drop("_who")


def last_values(frame: DataFrame, key: list[str], name: str, value: str, order: str) -> DataFrame:
    """For each key and name the value that comes last; null values do not count."""
    return frame.where(F.col(value).isNotNull()).groupBy(*key, name).agg(F.max_by(value, order).alias(value))


def settings(frame: DataFrame, file: list[str], order: str, value: str = "value") -> DataFrame:
    """name and value of 'name: value' lines, comments and quotes taken off, the last of a name winning."""
    clean = F.regexp_replace(F.col(value), r"\s+#.*$|^#.*$", "")
    pairs = frame.select(*file, order, F.regexp_extract(clean, r"^\s*(?:- )?([A-Za-z_][\w]*):\s*(.+?)\s*$", 1).alias("name"), F.regexp_extract(clean, r"^\s*(?:- )?([A-Za-z_][\w]*):\s*(.+?)\s*$", 2).alias("setting"))
    return last_values(pairs.where("name <> ''").withColumn("setting", F.regexp_replace("setting", r"^[\"']|[\"']$", "")), file, "name", "setting", order)


def addresses(frame: DataFrame, key: list[str], text: str) -> DataFrame:
    """name, address and port of the nodes in a printed mapping of nodes."""
    pattern = r"'([\w.-]+)'\s*[,:]?\s*NodeInfo\([^)]*?address='([^']*)'[^)]*?port=(\d+)"
    found = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "address"), (3, "port"))))
    return frame.select(*key, F.explode(found).alias("x")).select(*key, "x.name", "x.address", F.col("x.port").cast("int").alias("port"))


METRICS = (
    "timestamp string, cells array<struct<cell_metrics:struct<late_dl_harqs:bigint,late_ul_harqs:bigint,nof_failed_pdcch_allocs:bigint,nof_failed_uci_allocs:bigint,"
    "error_indication_count:bigint,msg3_nof_ok:bigint,msg3_nof_nok:bigint,max_latency:double>,event_list:array<struct<event_type:string>>,ue_list:array<struct<dl_brate:double,ul_brate:double>>>>"
)


def metrics(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Records of metrics arrays; where an array is cut short, its whole lines are saved one by one."""
    whole = F.from_json(text, f"array<struct<{METRICS.replace('timestamp string', 'timestamp:string').replace('cells array', 'cells:array')}>>")
    line = F.transform(F.split(text, "\n"), lambda x: F.from_json(F.regexp_replace(F.trim(x), r"^\[|,$|\]$", ""), METRICS))
    saved = F.filter(line, lambda x: x["timestamp"].isNotNull() | x["cells"].isNotNull())
    return texts.select(*key, F.explode(F.when(F.size(F.coalesce(whole, F.array())) > 0, whole).otherwise(saved)).alias("r")).select(*key, "r.*")


def metrics_rollup(records: DataFrame, key: list[str]) -> DataFrame:
    """Sums and peaks by key; missing numbers count as 0 and records without cells count as records only."""
    names = ("late_dl_harqs", "late_ul_harqs", "nof_failed_pdcch_allocs", "nof_failed_uci_allocs", "error_indication_count", "msg3_nof_ok", "msg3_nof_nok")
    cells = F.coalesce("cells", F.array())

    def total(name: str) -> Column:
        return F.sum(F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["cell_metrics"][name], F.lit(0)))).alias(name)

    def peak(name: str) -> Column:
        return F.max(F.array_max(F.flatten(F.transform(cells, lambda c: F.transform(F.coalesce(c["ue_list"], F.array()), lambda u: u[name]))))).alias(f"max_{name}")

    latency = F.max(F.array_max(F.transform(cells, lambda c: c["cell_metrics"]["max_latency"]))).alias("max_latency")
    return records.groupBy(*key).agg(F.count("*").alias("records"), *map(total, names), peak("dl_brate"), peak("ul_brate"), latency)


def cell_peaks(records: DataFrame, key: list[str], cell: str, down: str, up: str, good: str, bad: str) -> DataFrame:
    """For each cell the greatest rates, the blocks received well and badly, and the share of bad ones; null where there were none."""
    ok, nok = F.coalesce(F.sum(good), F.lit(0)), F.coalesce(F.sum(bad), F.lit(0))
    held = records.groupBy(*key, cell).agg(F.max(down).alias("peak_down"), F.max(up).alias("peak_up"), ok.alias("good"), nok.alias("bad"))
    return held.withColumn("error_rate", F.col("bad") / F.nullif(F.col("good") + F.col("bad"), F.lit(0)))
