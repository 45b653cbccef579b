"""Run folders, archives, captures, consoles, summaries, clocks and streams on small inputs."""

import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell.operators import clocks, procedures, search, sequences, summary, timeline
from tracewell.sources import captures, configs, consoles, logs, runs
from tracewell.streaming import live


def frame_of(spark, text, key="a"):
    return spark.createDataFrame([(key, i, x) for i, x in enumerate(text.split("\n"))], "k string, i int, value string")


def test_inventory_of_latest_runs(spark, tmp_path):
    for name in ("acme-cu-cp-0/2025-01-01_00-00-00/cu.log", "acme-gnb-0/2025-01-01_00-00-00/gnb.log", "acme-gnb-0/2025-01-02_00-00-00/mac.pcap", "acme-gnb-0/2025-01-02_00-00-00/gnb.log", "acme-gnb-0/2025-01-02_00-00-00/acme_gnb.yml",
                 "acme-gnb-0/2025-01-02_00-00-00/ngap.pcap", "acme-gnb-0/2025-01-02_00-00-00/metrics.json", "other-ue-1/ue.log", "other/x.txt"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x")
    files = runs.parts(runs.listing(spark, str(tmp_path)))
    got = {r.component: r for r in runs.inventory(files).collect()}
    assert {c: r.role for c, r in got.items()} == {"acme-cu-cp-0": "cu-cp", "acme-gnb-0": "gnb", "other-ue-1": "ue", "other": None}
    assert (got["acme-gnb-0"].run, got["acme-gnb-0"].logs, got["acme-gnb-0"].captures, got["acme-gnb-0"].metrics, got["acme-gnb-0"].configs) == ("2025-01-02_00-00-00", ["gnb.log"], ["ngap.pcap", "mac.pcap"], True, ["acme_gnb.yml"])
    assert (got["other-ue-1"].run, got["other-ue-1"].logs, got["other-ue-1"].metrics) == (None, ["ue.log"], False)
    (folder,) = runs.capture_folders(files).collect()
    assert folder.folder.endswith("2025-01-02_00-00-00") and folder.captures == ["mac.pcap", "ngap.pcap"]
    (last,) = runs.latest_path(files, [], "gnb.log").collect()
    assert last.path.endswith("2025-01-02_00-00-00/gnb.log")


def test_archive_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("logs/gnb.log", "one\ntwo")
        z.writestr("logs/other.bin", b"\xff")
        z.writestr("x/gnb.log", b"bad \xff byte")
    (tmp_path / "b.zip").write_bytes(b"not an archive")
    got = runs.archive_entries(spark.read.format("binaryFile").load(str(tmp_path)), r"gnb\.log$").collect()
    assert sorted((r.entry, r.text) for r in got) == [("logs/gnb.log", "one\ntwo"), ("x/gnb.log", "bad � byte")]


@pytest.mark.parametrize("order,magic,unit", [("<", 0xA1B2C3D4, 1000), (">", 0xA1B2C3D4, 1000), ("<", 0xA1B23C4D, 1)])
def test_frames_of_captures(spark, tmp_path, order, magic, unit):
    name = b"ngap"
    pdu = struct.pack(">HH", captures.DISSECTOR_NAME, len(name)) + name + struct.pack(">HH", 0, 0) + b"payload"
    raw = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, captures.EXPORTED_PDU)
    for sec in (5, 6):
        raw += struct.pack(order + "IIII", sec, 7, len(pdu), len(pdu) + 1) + pdu
    (tmp_path / "x.pcap").write_bytes(raw + struct.pack(order + "IIII", 9, 0, 100, 100) + b"cut")
    (tmp_path / "y.pcap").write_bytes(b"")
    got = sorted((r.frame, r.nanos, r.captured, r.length, r.dissector) for r in captures.frames(spark, str(tmp_path)).collect())
    assert got == [(k, s * 10**9 + 7 * unit, len(pdu), len(pdu) + 1, "ngap") for k, s in ((1, 5), (2, 6))]


def capture(order, magic, link, frames):
    raw = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return raw + b"".join(struct.pack(order + "IIII", sec, part, len(data), len(data) + 3) + data for sec, part, data in frames)


@pytest.mark.parametrize("size", [1, 500, 20_000, 1 << 26])
def test_frames_by_range_equal_whole_ones(spark, tmp_path, size):
    r = random.Random(size)
    name = b"f1ap"
    pdu = lambda: struct.pack(">HH", captures.DISSECTOR_NAME, len(name)) + name + struct.pack(">HH", 0, 0) + r.randbytes(r.choice([0, 10, 700]))
    long = capture("<", 0xA1B2C3D4, captures.EXPORTED_PDU, [(k // 3, k, pdu()) for k in range(60)])
    wide = capture(">", 0xA1B23C4D, 1, [(100 + k, 0, r.randbytes(400_000 if k % 4 == 0 else 40)) for k in range(9)])
    damaged = bytearray(long)
    damaged[24 + 8 : 24 + 12] = struct.pack("<I", 2**31)  # a length beyond the file's end
    for file, raw in {"a": long, "b": wide, "cut": long[:-5], "head": long[:30], "damaged": bytes(damaged), "none": b"", "other": b"x" * 99, "bare": long[:24]}.items():
        (tmp_path / f"{file}.pcap").write_bytes(raw)
    want = sorted(map(tuple, captures.frames(spark, str(tmp_path)).collect()))
    assert len(want) == 60 + 9 + 59
    assert sorted(map(tuple, captures.frames_by_range(spark, str(tmp_path), size).collect())) == want
    some = captures.frames_by_range(spark, str(tmp_path), size, 5 * 10**9, 102 * 10**9)
    assert sorted(map(tuple, some.collect())) == [x for x in want if 5 * 10**9 <= x[2] < 102 * 10**9]


def test_entries_by_parts(spark, tmp_path):
    line = "2025-01-02 a line of a log, é\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/gnb.log", line * 4_000_000)  # 120 MB
        z.writestr("y/gnb.log", b"bad \xff byte")
        z.writestr("z/gnb.log", "")
        z.writestr("other.log", "no")
    whole = (tmp_path / "a.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "damaged.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("gnb.log", "good line\n" * 100)
    raw = bytearray((tmp_path / "damaged.zip").read_bytes())
    raw[200] ^= 1
    (tmp_path / "damaged.zip").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "locked.zip", "w") as z:
        z.writestr("gnb.log", "secret")
    raw = bytearray((tmp_path / "locked.zip").read_bytes())
    raw[raw.rindex(b"PK\x01\x02") + 8] |= 1  # the mark of an encrypted entry
    (tmp_path / "locked.zip").write_bytes(raw)
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    got = runs.entry_parts(spark, str(tmp_path), r"gnb\.log$").withColumn("file", F.element_at(F.split("path", "/"), -1))
    sizes = got.where("file = 'a.zip'").groupBy("entry").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("most"), F.bool_and(F.col("text").endswith("\n")).alias("lines"), F.max("part").alias("last"))
    (x, y) = sorted(map(tuple, sizes.collect()))
    assert x[0] == "x/gnb.log" and x[2] == 4_000_000 * len(line) and x[1] == x[5] + 1 > 10 and x[3] <= (8 << 20) + 100 and x[4]
    assert y == ("y/gnb.log", 1, 10, 10, False, 0)
    rest = sorted((r.file, r.text and r.text[:9], r.error and r.error[:10]) for r in got.where("file <> 'a.zip'").collect())
    assert rest == [("damaged.zip", None, "BadZipFile"), ("locked.zip", None, "encrypted")] or rest == [("damaged.zip", "good line", "BadZipFile"), ("locked.zip", None, "encrypted")]


def test_typed_fields_and_summaries(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("1\t1700000000.000001500\t15\t7\n2\t\t15\t7\n3\t1700000001.5\t\t\textra\n4\t1700000002\t99\n")
    frame = captures.typed(captures.fields(spark, str(tmp_path / "f.tsv"), ["frame", "epoch", "code", "ue"]), "epoch", ("frame", "code", "ue"))
    named = captures.named(frame.withColumn("proto", F.lit("ngap"))).orderBy("frame").collect()
    assert [(r.frame, r.t, r.procedure, r.ue) for r in named] == [(1, 1700000000000002, "InitialUEMessage", 7), (3, 1700000001500000, "?", None), (4, 1700000002000000, "proc-99", None)]
    rows = spark.createDataFrame([("mac", "17921", "0", None), ("rlc", "5", "1", "2"), ("mac", None, None, None), ("f1ap", "11", None, None)], "p string, a string, b string, c string")
    said = rows.select(captures.event_summary(F.col("p"), F.col("a"), F.col("b"), F.col("c")).alias("summary"), F.array("b").alias("ue_ids"))
    assert [r.summary for r in said.collect()] == ["rnti=17921 dir=UL", "ueid=5 bearer=1/2", "rnti=- dir=?", "procCode=11"]
    assert [r.summary for r in captures.of_entity(said, "5").collect()] == ["ueid=5 bearer=1/2"]
    assert [r.summary for r in captures.of_entity(said, "0").collect()] == ["rnti=17921 dir=UL"]


def test_consoles(spark):
    radio = frame_of(spark, "==== Acme gNB (commit abc123) ====\nCell pci=1, bw=20 MHz\nN2: Connection to AMF completed\n==== gNB started ===\n   1 4601 |  15 1.0  27  15M |  20\n pci rnti |\nStopping...\nLogfile stored in /tmp/gnb.log")
    (r,) = consoles.radio_console(radio, ["k"], "i").collect()
    assert (r.commit, r.cells, r.core, r.started, r.stopped, r.logfile, r.metrics_rows) == ("abc123", ["Cell pci=1, bw=20 MHz"], True, True, True, "/tmp/gnb.log", 1)
    (row,) = consoles.radio_table(radio, ["k"]).collect()
    assert (row.pci, row.rnti, row.cells) == (1, 0x4601, [["15", "1.0", "27", "15M"], ["20"]])
    device = frame_of(spark, "UE version 2025-01-02\nRF0: x\n[10.0.0.1] CBR_RECV: sent 200, recv 150\n[10.0.0.1] CBR_SEND: sent 0, recv 0\nCell 3: SIB found\nWarning: unused property a\nWarning: late")
    (d,) = consoles.device_console(device, ["k"], "i").collect()
    assert (d.version, d.radio_ports, d.cells, d.warnings) == ("2025-01-02", ["RF0: x"], [3], ["Warning: late"])
    assert [(f.way, f.sent, f.received, f.loss) for f in consoles.flows(device, ["i"]).orderBy("i").collect()] == [("recv", 200, 150, 25.0), ("send", 0, 0, 0.0)]
    job = consoles.job_lines(frame_of(spark, "\x1b[31m3 passed, 1 failed\x1b[0m\nstep has 2 warnings\nsection_start:1:after_script\n9 failed"), ["k"], "i")
    (c,) = consoles.job_counts(job, ["k"]).collect()
    assert (c.passed, c.failed, c.skipped, c.errors, c.warnings) == (3, 1, 0, 0, 2)


DEVICE = """# Started on 2025-01-02 23:59:58
23:59:58.100 [PROD] - SIM-Event: power_on
23:59:58.200 [PHY] UL 0001 00 4601 10.3 PRACH: sequence_index=4
23:59:58.300 [PHY] DL 0001 00 - 11.3 PDSCH: crc=FAIL
23:59:59.000 [RRC] UL 0001 01 DCCH-NR: RRC reestablishment request
23:59:59.100 [RRC] DL 0001 01 DCCH-NR: RRC reconfiguration
        reconfigurationWithSync {
        [E] body
00:00:01.000 [NAS] - 0001 New state : 5GMM-REGISTERED CM-CONNECTED
00:00:01.500 [NAS] - 00012 New state : 5GMM-DEREGISTERED CM-IDLE
# Ended on 2025-01-03 00:00:02"""


def test_device_summary_and_clock(spark):
    lines = frame_of(spark, DEVICE)
    (r,) = summary.device_summary(lines, ["k"], "i").collect()
    assert (r.handovers, r.errors, r.random_accesses, r.crc_fails, r.reestablishments, r.ues, r.cells) == (1, 1, 1, 1, 1, ["0001"], ["01"])
    assert (r.started_on, r.ended_on, r.first_ts, r.last_ts) == ("2025-01-02 23:59:58", "2025-01-03 00:00:02", "23:59:58.100", "00:00:01.500")
    fields = summary.device_fields(lines)
    assert [x.kind for x in summary.key_messages(fields).orderBy("i").collect()] == ["RRC reestablishment request", "RRC reconfiguration"]
    assert [(x.direction, x.rnti, x.slot) for x in summary.device_phy(lines, ["i"]).orderBy("i").collect()] == [("UL", 0x4601, "10.3"), ("DL", None, "11.3")]
    anchors = spark.createDataFrame([("a", "2025-01-02")], "k string, date string")
    timed = clocks.dated(fields.where("ts is not null"), anchors, ["k"], "i").orderBy("i").collect()
    assert timed[-1].t - timed[0].t == 3_400_000 and timed[0].t == 1735862398100000


def test_radio_summary(spark):
    text = "\n".join(
        f"2025-01-02T03:04:{k:02}.000001 [{layer:<8}] [{level}] {m}"
        for k, (layer, level, m) in enumerate(
            [("GNB", "I", "Built in Release mode using commit abc on branch main"), ("CU-CP", "I", "Connection to AMF on x was established"), ("NGAP", "I", "NGSetupFailure"), ("NGAP", "I", "NGSetupResponse"), ("SCHED", "I", "Cell creation idx=0 pci=7"),
             ("SCHED", "W", "UE creation (ue=1) took long"), ("PHY", "W", "late"), ("CU-CP", "I", "ue=12 c-rnti=0x4601: UE created"), ("CU-CP", "I", 'ue=12: "Initial Context Setup Routine" finished successfully'),
             ("CU-CP-E1", "I", "BearerContextModificationResponse"), ("CU-CP", "I", 'ue=12: "UE Removal Routine" finished successfully'), ("METRICS", "I", "one"), ("METRICS", "I", "two"), ("GNB", "I", "Closing PCAP files"), ("GNB", "I", "Workers stopped successfully")]
        )
    )
    (r,) = summary.radio_summary(frame_of(spark, text), ["k"], "i").collect()
    assert (r.commit, r.branch, r.core_setup, r.core_connected_ts[-9:], r.shutdown_ts[-9:], r.clean_shutdown, r.last_metrics) == ("abc", "main", "success", "01.000001", "13.000001", True, "two")
    assert (r.warnings, r.benign_warnings, r.created, r.contexts_done, r.released, r.bearer_changes, r.metrics_rows, r.ues, r.rntis, r.pcis) == (1, 1, 1, 1, 1, 1, 2, [12], [0x4601], [7])
    rows = summary.report(spark.createDataFrame([("a", 1, None)], "k string, x int, y int"), ["k"], {"s": ["x", "y"]}).collect()
    assert [(x.section, x.label, x.value) for x in rows] == [("s", "x", "1")]


def test_settings_rules(spark):
    config = frame_of(spark, "rrc_level: warning\nmac_level: warning\nngap_enable: true\nmac_enable: true\nmac_enable: false\nfoo_enable: true")
    held = logs.settings(config, ["k"], "i")
    assert [r.layer for r in summary.muted(held, ["k"]).collect()] == ["rrc"]
    assert [r.proto for r in summary.captures_on(held, ["k"]).collect()] == ["ngap"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, i int, value string")
    for got in (summary.radio_summary(none, ["k"], "i"), summary.device_summary(none, ["k"], "i"), consoles.radio_console(none, ["k"], "i"), consoles.job_lines(none, ["k"], "i"), summary.radio_phy(none, ["k"])):
        assert got.count() == 0
    events = spark.createDataFrame([], "k string, t bigint, id bigint")
    assert procedures.nearest(events, events, ["k"], 5).count() == 0
    one = spark.createDataFrame([("a", None, 1), ("a", 3, 2)], "k string, t bigint, id bigint")
    assert sorted((r.id, r.other_id) for r in procedures.nearest(one, one.where("t = 3"), ["k"], 5, 5).collect()) == [(1, None), (2, 2)]


def test_streams_equal_batch(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.log").write_text("".join(f"2025-01-02T03:04:{s:02}.000001 [PHY     ] [{'E' if s % 4 == 0 else 'I'}] ue={k} x\nbody\n" for s in range(k, 60, 3)))
    stream = live.events(live.log_lines(spark, str(folder), 1), "10 minutes")
    counted = live.counters(stream, ["layer"], {"errors": F.col("level") == "E"}, "10 seconds")
    query = counted.writeStream.format("memory").queryName("live_counts").outputMode("complete").option("checkpointLocation", str(out)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.start.second, r.n, r.errors) for r in spark.table("live_counts").collect())
    assert got == [(s, 10, sum(x % 4 == 0 for x in range(s, s + 10))) for s in range(0, 60, 10)]


def test_sessions_and_pairs_of_streams(spark, tmp_path):
    folders = [tmp_path / x for x in ("one", "other")]
    for k, folder in enumerate(folders):
        folder.mkdir()
        (folder / "a.log").write_text("".join(f"2025-01-02T03:{m:02}:{s + k:02}.000001 [PHY     ] [I] ue={u} x\n" for m, s, u in [(0, 0, 1), (0, 5, 1), (0, 40, 1), (0, 2, 2), (59, 0, 9)]))
    streams = [live.events(live.log_lines(spark, str(f)), "1 second") for f in folders]

    def run(frame, name):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    got = run(live.sessions(streams[0], ["ue"], "20 seconds"), "live_sessions")
    assert sorted((r.ue, r.start.second, r.last.second, r.n) for r in got) == [("1", 0, 5, 2), ("1", 40, 40, 1), ("2", 2, 2, 1)]
    sides = [s.select("ue", F.concat("ue", F.lit("@"), F.col("ts").substr(15, 5)).alias("id"), "time") for s in streams]
    pairs = sorted((r.ue, r.a_id, r.b_id) for r in run(live.close_pairs(*sides, ["ue"], "3 seconds"), "live_pairs"))
    assert pairs == [("1", "1@00:00", "1@00:01"), ("1", "1@00:05", "1@00:06"), ("1", "1@00:40", "1@00:41"), ("2", "2@00:02", "2@00:03"), ("9", "9@59:00", "9@59:01")]


def test_moves_and_loops(spark):
    rows = spark.createDataFrame([("u", 1, "begin", 1), ("u", 2, "end", 2), ("u", 3, "begin", 2), ("u", 4, "begin", 2), ("u", 5, "end", 2)], "k string, o int, what string, cell int")
    assert [(r.o, r.cell, r.place_after) for r in timeline.moves(rows, ["k"], F.col("what") == "begin", F.col("what") == "end", "cell", "o").collect()] == [(1, 1, 2)]
    assert [r.loop for r in timeline.loops(rows, ["k"], F.col("what") == "begin", ["o"]).orderBy("o").collect()] == [1, 1, 2, 3, 3]


def test_sequences(spark):
    said = [("a", 1, "SCTP-GW", "N2: Bind to 1 address(es) was successful"), ("a", 2, "SCTP-GW", "N2: Successfully connected to 1 address(es)"), ("a", 3, "SCTP-GW", "N2: SCTP connection to AMF established."),
            ("a", 4, "NGAP", "Tx PDU: NGSetupRequest"), ("a", 5, "NGAP", "Rx PDU: NGSetupFailure"), ("b", 1, "PHY", "x")]
    parsed = spark.createDataFrame(said, "k string, i int, layer string, message string")
    assert [tuple(r) for r in sequences.reached(parsed, ["k"], "i", "core setup").collect()] == [("a", 3, 3, 4, [1, 2, 3, 5])]
    assert [(r.i, r.meaning) for r in sequences.markers(parsed, ["k", "i"]).collect()] == [(5, "refused by the core network")]


def test_steps_in_chunks_equal_one_walk(spark):
    import random

    r = random.Random(3)
    rows = [(k, i, r.choice("abcx")) for k in range(40) for i in range(r.randint(1, 60))]
    expected, want = ["a", "b", "a", "c", "b", "a", "c", "c"], {}
    for k, _, x in rows:
        at = want.setdefault(k, 0)
        want[k] = at + (at < len(expected) and expected[at] == x)
    frame = spark.createDataFrame(rows, "k int, i int, x string")
    for chunk in (1, 7, 1000):
        assert {x.k: x.reached for x in timeline.steps(frame, ["k"], "x", "i", expected, chunk).collect()} == want


def test_configs(spark):
    text = 'cells:\n  pci: 1 # one\n  pci: 2\n  duplex: tdd\ncu_cp:\n  amf:\n    addrs: "10.0.0.9"\n    port: 38412\n    bind_addrs: 10.0.0.1\n  port: 5\nrrc_level: warning\nother: 3'
    whole = spark.createDataFrame([("a", text)], "k string, text string")
    (r,) = configs.radio_network(whole, ["k"], "text").collect()
    assert tuple(r) == ("a", True, ["10.0.0.9"], ["10.0.0.1"], 38412)
    got = {r.name: (r.setting, r.level_of) for r in configs.radio_settings(frame_of(spark, text), ["k"], "i").collect()}
    assert got == {"pci": ("2", None), "rrc_level": ("warning", "rrc")}
    device = '{ // note\n// band: 9,\n args: "tcp://*:31000", rf_port: 0,\n /* band: 8 */ band: 78, bandwidth: 20,\n rf_port: 1, imsi: "00101", ue_count: 4,\n event: "power_on", event: "cbr", event: "power_on" }'
    (d,) = configs.device_config(spark.createDataFrame([("a", device), ("b", None)], "k string, text string"), ["k"], "text").where("k = 'a'").collect()
    assert tuple(d) == ("a", 4, [78], [20.0], 2, "00101", ["power_on", "cbr"])


def test_config_echo(spark):
    heads = spark.createDataFrame([("2025-01-02T03:04:05.000001 [CONFIG  ] [D] Input configuration (all values):",), ("2025-01-02T03:04:05.000001 [CONFIG  ] [I] Input configuration",)], "head string")
    assert [r.echo for r in heads.select(search.is_config_echo().alias("echo")).collect()] == [True, False]
