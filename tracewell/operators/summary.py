"""Summaries of whole logs: counters, flags and samples in one pass, one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources import logs

#: Warnings of healthy runs.
BENIGN_WARNINGS = ("DRM KMS polling is enabled", "hyperthreading", "UE creation (ue=", "MAC UE creation (ue=")
#: Radio-resource messages that a device's timeline shows.
KEY_MESSAGES = (
    "MIB", "SIB1", "RRC setup", "RRC setup complete", "Security mode command", "Security mode complete", "RRC reconfiguration", "RRC reconfiguration complete",
    "RRC reestablishment", "RRC reestablishment request", "RRC reestablishment complete", "RRC release", "RRC reject",
)
#: Configuration keys that set layers' log levels whose counters read 0 when muted.
MUTED_LAYERS = ("rrc", "ngap", "f1ap", "e1ap", "cu")
#: Captures that a configuration can switch on.
CAPTURE_SWITCHES = ("ngap", "f1ap", "e1ap", "mac", "rlc", "n3", "f1u", "xnap", "e2ap_cu_cp", "e2ap_cu_up", "e2ap_du")
#: Lines of the physical layer in the two kinds of log.
RADIO_PHY = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d+)\s+\[PHY\s*\]\s+\[\w\]\s+\[\s*(\d+\.\d+)\]\s+(PRACH|PUSCH|PUCCH|PDCCH|PDSCH):\s*(.*)$"
DEVICE_PHY = r"^(\d\d:\d\d:\d\d\.\d+)\s+\[PHY\]\s+(UL|DL)\s+([0-9a-fA-F]+)\s+(\d+)\s+([0-9a-fA-F]+|-)\s+(\d+\.\d+)\s+(PRACH|PUSCH|PUCCH|PDCCH|PDSCH):\s*(.*)$"


def any_of(column: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of the words; the text, however it is made, is looked through once."""
    return column.rlike("|".join(rf"\Q{w}\E" for w in words))


def _got(column: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def radio_tests() -> dict[str, Column]:
    """What is counted over a radio node's parsed lines."""
    layer, level, m = F.col("layer"), F.col("level"), F.col("message")
    benign = any_of(m, BENIGN_WARNINGS)
    setup, change = m.contains("SetupResponse"), m.contains("ModificationResponse")
    bearer = layer == "CU-CP-E1"
    return {
        "errors": level.isin("E", "C"),
        "warnings": (level == "W") & ~benign,
        "benign_warnings": (level == "W") & benign,
        "handovers_ngap": (layer == "NGAP") & any_of(m, ("HandoverRequired", "HandoverRequest")),
        "random_accesses": (layer == "SCHED") & m.contains("prach("),
        "crc_fails": (layer == "PHY") & m.contains("crc=KO"),
        "created": (layer == "CU-CP") & m.contains(": UE created"),
        "contexts_done": (layer == "CU-CP") & m.contains('"Initial Context Setup Routine"') & m.contains("finished successfully"),
        "released": (layer == "CU-CP") & m.contains('"UE Removal Routine"') & m.contains("finished successfully"),
        "reconfigurations": (layer == "RRC") & m.contains("rrcReconfiguration") & ~m.contains("Complete"),
        "reestablishments": (layer == "RRC") & any_of(m, ("rrcReestablishmentRequest", "reestablishmentRequest")),
        "handovers_header_only": m.contains("reconfigurationWithSync") & m.contains("{"),
        "bearer_setups": bearer & setup,
        "bearer_changes": bearer & ~setup & change,
        "bearer_releases": bearer & ~setup & ~change & m.contains("ReleaseComplete"),
        "metrics_rows": layer == "METRICS",
    }


def last_where(value: Column, test: Column, order: str) -> Column:
    return F.max_by(value, F.when(F.coalesce(test, F.lit(False)), F.col(order)))


def radio_summary(lines: DataFrame, key: list[str], order: str, value: str = "value") -> DataFrame:
    """One row for each key from the lines of radio-node logs: counters, build, core network, cells, entities and end.

    Counts are whole; samples are cut by sample_lines.  Where several lines tell of the core
    network or the build the last one counts; the sign of a shutdown is the first.
    """
    p = logs.parse_radio(lines, value)
    layer, m, ts = F.col("layer"), F.col("message"), F.col("ts")
    built = (layer == "GNB") & m.contains("Built in")
    commit, branch = _got(m, r"commit (\S+)"), _got(m, r"on branch (\S+)")
    answered = (layer == "NGAP") & any_of(m, ("NGSetupResponse", "NGSetupFailure"))
    connected = (layer == "CU-CP") & m.contains("Connection to AMF") & m.contains("established")
    cell = (layer == "SCHED") & m.contains("Cell creation idx=")
    created = radio_tests()["created"]
    numbers = {"ues": F.when(created, F.col("ue").try_cast("bigint")), "rntis": F.when(created, fn.hex_id(F.col("rnti"))), "pcis": F.when(cell, F.col("pci").try_cast("bigint"))}
    return p.groupBy(*key).agg(
        F.count("*").alias("lines"), F.min_by("ts", order).alias("first_ts"), F.max_by("ts", order).alias("last_ts"),
        *(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in radio_tests().items()),
        last_where(commit, built & commit.isNotNull(), order).alias("commit"), last_where(branch, built & branch.isNotNull(), order).alias("branch"),
        last_where(F.when(m.contains("NGSetupResponse"), "success").otherwise("failure"), answered, order).alias("core_setup"),
        last_where(ts, connected, order).alias("core_connected_ts"),
        F.min_by(ts, F.when(m.contains("Closing PCAP files"), F.col(order))).alias("shutdown_ts"),
        F.bool_or(m.contains("Workers stopped successfully")).alias("clean_shutdown"),
        last_where(m, layer == "METRICS", order).alias("last_metrics"),
        *(F.array_sort(F.collect_set(c)).alias(n) for n, c in numbers.items()),
    )


def sample_lines(parsed: DataFrame, key: list[str], kind: Column, order: str, n: int) -> DataFrame:
    """The first n rows of each kind, by key; rows of no kind go."""
    w = Window.partitionBy(*key, "kind").orderBy(order)
    held = parsed.withColumn("kind", kind).where("kind is not null")
    return held.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def device_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """A test device's lines with the fields of those that have a header; bodies stay, with nulls.

    state_ue, registration and connection come from state lines, event from SIM events, cell,
    channel and kind from radio-resource lines.
    """
    v = F.col(value)
    head = v.rlike(logs.DEVICE_HEADER)

    def part(k: int) -> Column:
        return F.when(head, F.regexp_extract(v, logs.DEVICE_HEADER, k))

    parsed = lines.select("*", part(1).alias("ts"), part(2).alias("layer"), part(3).alias("direction"), part(4).alias("message"))
    m, layer = F.col("message"), F.col("layer")
    state, rrc = r"(\S+)\s+New state\s*:\s*(\S+)\s+(\S+)", r"^(\S+)\s+(\S+)\s+([\w\-]+):\s*(.*)"
    of = lambda on, pattern, k: F.when(layer == on, F.nullif(F.regexp_extract(m, pattern, k), F.lit("")))
    return parsed.select(
        "*", of("NAS", state, 1).alias("state_ue"), of("NAS", state, 2).alias("registration"), of("NAS", state, 3).alias("connection"), of("PROD", r"SIM-Event:\s*(\S+)", 1).alias("event"),
        of("RRC", rrc, 2).alias("cell"), of("RRC", rrc, 3).alias("channel"), of("RRC", rrc, 4).alias("kind"),
    )


def device_summary(lines: DataFrame, key: list[str], order: str, value: str = "value") -> DataFrame:
    """One row for each key from the lines of device logs.

    Handovers are lines that open the structure of a synchronised reconfiguration, bodies
    included, and count for nothing else.  Errors count in any other line.
    """
    p = device_fields(lines, value)
    v, layer, m = F.col(value), F.col("layer"), F.col("message")
    moved = v.rlike(r"reconfigurationWithSync\s*\{")
    rest = ~moved
    tests = {
        "handovers": moved,
        "errors": rest & any_of(v, ("[E]", " ERROR ")),
        "random_accesses": rest & (layer == "PHY") & m.contains("PRACH:"),
        "crc_fails": rest & (layer == "PHY") & m.contains("crc=FAIL"),
        "reestablishments": rest & (layer == "RRC") & F.lower("kind").contains("reestablishment request"),
    }
    timed = rest & F.col("ts").isNotNull()
    date = r"(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)"
    return p.groupBy(*key).agg(
        F.count("*").alias("lines"), F.min_by("ts", F.when(timed, F.col(order))).alias("first_ts"), F.max_by("ts", F.when(timed, F.col(order))).alias("last_ts"),
        *(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()),
        *(last_where(_got(v, rf"{w} on {date}"), v.startswith("#") & v.rlike(rf"{w} on {date}"), order).alias(n) for w, n in (("Started", "started_on"), ("Ended", "ended_on"))),
        F.array_sort(F.collect_set(F.when(F.col("state_ue").rlike(f"^{fn.HEX_ID}$"), F.col("state_ue")))).alias("ues"),
        F.array_sort(F.collect_set(F.when(F.col("cell").rlike("^[0-9]{2}$"), F.col("cell")))).alias("cells"),
    )


def key_messages(fields: DataFrame) -> DataFrame:
    """Radio-resource lines of broadcast channels, or of a kind that tells of a connection's life."""
    kind = F.lower("kind")
    return fields.where(F.col("channel").startswith("BCCH") | any_of(kind, tuple(sorted({k.lower() for k in KEY_MESSAGES}))))


def radio_phy(lines: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    """Physical-layer events of a radio node: ts, slot, kind, rnti, crc, sinr, silent and preambles."""
    v = F.col(value)
    held = lines.where(v.contains("[PHY") & v.rlike(RADIO_PHY))
    rest = F.regexp_extract(v, RADIO_PHY, 4)
    sinr = _got(rest, r"\bsinr=(\S+)")
    return held.select(
        *keep, F.regexp_extract(v, RADIO_PHY, 1).alias("ts"), F.regexp_extract(v, RADIO_PHY, 2).alias("slot"), F.regexp_extract(v, RADIO_PHY, 3).alias("kind"), fn.hex_id(_got(rest, r"\brnti=(0x[0-9a-fA-F]+)")).alias("rnti"),
        _got(rest, r"\bcrc=(OK|KO)").alias("crc"), sinr.alias("sinr"), sinr.contains("inf").alias("silent"), F.size(F.regexp_extract_all(rest, F.lit(r"idx=(\d+)"), F.lit(1))).alias("preambles"),
    )


def device_phy(lines: DataFrame, keep: list[str], value: str = "value") -> DataFrame:
    """Physical-layer events of a device: ts, direction, ue, cell, rnti (null for -), slot and kind."""
    v = F.col(value)
    names = ("ts", "direction", "ue", "cell", "rnti", "slot", "kind")
    held = lines.where(v.contains("[PHY]") & v.rlike(DEVICE_PHY)).select(*keep, *(F.regexp_extract(v, DEVICE_PHY, k + 1).alias(n) for k, n in enumerate(names)))
    return held.withColumn("rnti", fn.hex_id(F.col("rnti")))


def muted(settings: DataFrame, key: list[str]) -> DataFrame:
    """Layers whose log level hides what their counters count; settings are rows of key, name and setting."""
    layer = F.regexp_replace("name", "_level$", "")
    return settings.where(layer.isin(*MUTED_LAYERS) & (F.lower("setting") == "warning")).select(*key, layer.alias("layer"))


def captures_on(settings: DataFrame, key: list[str]) -> DataFrame:
    """Captures that a configuration switches on, once each."""
    proto = F.regexp_replace("name", "_enable$", "")
    return settings.where(F.col("name").endswith("_enable") & proto.isin(*CAPTURE_SWITCHES) & (F.col("setting") == "true")).select(*key, proto.alias("proto")).distinct()


def headline(pci: str, band: str, bandwidth: str, spacing: str, arfcn: str, transmit: str, receive: str) -> Column:
    """A cell in one line; what is null is left out."""
    ports = F.concat(F.col(transmit).cast("string"), F.lit("T"), F.col(receive).cast("string"), F.lit("R"))
    named = (("pci=", pci, ""), ("n", band, ""), ("", bandwidth, " MHz"), ("", spacing, " kHz"), ("arfcn=", arfcn, ""))
    return F.concat_ws(", ", *(F.concat(F.lit(a), F.col(c).cast("string"), F.lit(z)) for a, c, z in named), ports)


def report(summary: DataFrame, key: list[str], sections: dict[str, list[str]]) -> DataFrame:
    """A summary in long form: key, section, ord, label and value; nulls are left out."""
    rows = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("ord"), F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for k, (s, c) in enumerate((s, c) for s, cs in sections.items() for c in cs)]
    return summary.select(*key, F.inline(F.array(*rows))).where("value is not null")
