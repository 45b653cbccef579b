import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as fn
from tracewell import shared
from tracewell.operators import identity, pairing, rules
from tracewell.sources import logs

LOG = """2025-01-02T03:04:05.000001 [GNB     ] [I] Built in mode
loose
2025-01-02T03:04:06.000002 [CU-CP   ] [W] ue=5 c-rnti=0x4601: UE created

  body one
[zmq:rx:0:0] not a header
2025-01-02T03:04:07.000003 [PHY     ] [E] pci=1 crc=KO"""


def two_cursors(a, b, tolerance):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if abs(a[i][0] - b[j][0]) <= tolerance:
            out.append((a[i][1], b[j][1]))
            i, j = i + 1, j + 1
        elif a[i][0] < b[j][0]:
            out.append((a[i][1], None))
            i += 1
        else:
            out.append((None, b[j][1]))
            j += 1
    return out + [(x, None) for _, x in a[i:]] + [(None, x) for _, x in b[j:]]


def test_pairing_equals_two_cursors(spark):
    r = random.Random(5)
    sides, expected = ([], []), []
    for key in range(300):
        own = []
        for side in (0, 1):
            times = sorted(r.randint(0, 60) for _ in range(r.randint(0, 8)))
            own.append([(t, 100 * key + k) for k, t in enumerate(times)])
            sides[side].extend((key if key else None, t, i) for t, i in own[-1])
        expected += [(key if key else None, *x) for x in two_cursors(*own, 5)]
    a, b = (spark.createDataFrame(s, "k long, t long, id long") for s in sides)
    for chunk in (1, 3, 1024):
        got = [tuple(x) for x in pairing.pair(a, b, ["k"], 5, chunk).select("k", "a_id", "b_id").collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_pairing_one_dense_key(spark):
    r = random.Random(6)
    sides = [[(t, 10**6 * side + k) for k, t in enumerate(sorted(r.randint(0, 3000) for _ in range(1500)))] for side in (0, 1)]
    a, b = (spark.createDataFrame([("x", *e) for e in s], "k string, t long, id long") for s in sides)
    got = [tuple(x) for x in pairing.pair(a, b, ["k"], 5, 4).select("a_id", "b_id").collect()]
    assert sorted(got, key=repr) == sorted(two_cursors(*sides, 5), key=repr)


def test_pairing_an_odd_event_before_many_chunks(spark):
    """Every pair of a long row depends on the first event; the jobs run do not grow with the chunks that it passes."""
    jobs = []
    for n in (10, 1100):
        sides = [[(0, -1)] + [(4 + 8 * k, k) for k in range(5 * n)], [(8 + 8 * k, k) for k in range(5 * n)]]  # chunks of 40: five of either side in each
        a, b = (spark.createDataFrame([("x", *e) for e in s], "k string, t long, id long") for s in sides)
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
        got = [tuple(x) for x in pairing.pair(a, b, ["k"], 5, 8).select("a_id", "b_id").collect()]
        assert sorted(got, key=repr) == sorted(two_cursors(*sides, 5), key=repr)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before)
    assert jobs[1] <= jobs[0] + 2


def test_log_blocks_and_fields(spark, tmp_path):
    (tmp_path / "x.log").write_text(LOG)
    whole = spark.createDataFrame([("f", LOG), ("g", ""), ("h", "no header")], "file string, text string")
    got = logs.blocks(whole, ["file"], "text", logs.RADIO_HEADER).orderBy("block").collect()
    assert [(r["file"], r["block"], r["body"], r["n_lines"]) for r in got] == [("f", 0, ["loose"], 2), ("f", 1, ["  body one", "[zmq:rx:0:0] not a header"], 3), ("f", 2, [], 1)]
    lines = logs.lines(spark, str(tmp_path))
    numbered = logs.blocks_of_lines(lines, ["file"], ["part", "ord"], logs.RADIO_HEADER).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in numbered] == [2, 3, 1]
    parsed = logs.parse_radio(lines).orderBy("ts").collect()
    assert [(r["layer"], r["level"], r["ue"], r["pci"], r["rnti"]) for r in parsed] == [("GNB", "I", None, None, None), ("CU-CP", "W", "5", None, "0x4601"), ("PHY", "E", None, "1", None)]
    device = spark.createDataFrame([("01:02:03.004 [NAS] UL  0001 New state",), ("# comment",)], "value string")
    assert logs.parse_device(device).select("layer", "direction", "message").first() == ("NAS", "UL", "0001 New state")


def test_settings_and_addresses(spark):
    rows = [("f", k, v) for k, v in enumerate(["a: 1 # one", "# a: 9", "b: 'x y'", "  a: 2", "- c: \"z\"", "nothing"])]
    got = logs.settings(spark.createDataFrame(rows, "file string, ord int, value string"), ["file"], "ord").collect()
    assert {r["name"]: r["setting"] for r in got} == {"a": "2", "b": "x y", "c": "z"}
    text = "OrderedDict([('gnb-0', NodeInfo(kind='x', address='10.0.0.1', port=22)), ('ue-1', NodeInfo(address='10.0.0.2', port=23))])"
    got = logs.addresses(spark.createDataFrame([("r", text)], "run string, text string"), ["run"], "text").collect()
    assert [tuple(r) for r in got] == [("r", "gnb-0", "10.0.0.1", 22), ("r", "ue-1", "10.0.0.2", 23)]


@pytest.mark.parametrize("cut", [False, True])
def test_metrics(spark, cut):
    records = [
        {"timestamp": "1", "cells": [{"cell_metrics": {"late_dl_harqs": 2, "max_latency": 3.5}, "ue_list": [{"dl_brate": 5.0}, {"dl_brate": 7.0, "ul_brate": 1.0}]}]},
        {"timestamp": "2", "cells": [{"cell_metrics": {"late_dl_harqs": None, "msg3_nof_ok": 4}}]},
        {"timestamp": "3"},
    ]
    text = "[" + ",\n".join(map(json.dumps, records)) + (",\n{\"timest" if cut else "]")
    frame = logs.metrics(spark.createDataFrame([("r", text)], "run string, text string"), ["run"], "text")
    r = logs.metrics_rollup(frame, ["run"]).first()
    assert (r["records"], r["late_dl_harqs"], r["msg3_nof_ok"], r["max_dl_brate"], r["max_ul_brate"], r["max_latency"]) == (3, 2, 4, 7.0, 1.0, 3.5)


def test_scalars(spark):
    frame = spark.createDataFrame([("0x4601", "15M", "3.14", "\x1b[31mred\x1b[0m", "Setup, Other [x]", "1/2.4/3"), ("-", "n/a", "x", "a", "", "1")], "id string, n string, slot string, ansi string, info string, three string")
    got = frame.select(
        fn.hex_id(F.col("id")).alias("id"), fn.scaled_number(F.col("n")).alias("n"), fn.slot_key(F.col("slot")).alias("slot"), fn.strip_ansi(F.col("ansi")).alias("ansi"), fn.message_name(F.col("info")).alias("info"), fn.triple(F.col("three")).alias("three")
    ).collect()
    assert got[0]["id"] == 0x4601 and got[0]["n"] == 15e6 and tuple(got[0]["slot"]) == (3, 14) and got[0]["ansi"] == "red" and got[0]["info"] == "Setup" and tuple(got[0]["three"]) == (1, 2.4, 3)
    assert got[1]["id"] is None and got[1]["n"] is None and got[1]["slot"] is None and got[1]["info"] is None


def test_identity(spark):
    rows = [("r", 1, "new", None, 1, 11), ("r", 2, "x", 7, 1, None), ("r", 3, "x", 7, 2, None), ("r", 4, "x", None, None, 12), ("r", 5, "release", 7, None, None), ("r", 6, "x", 7, None, None)]
    frame = spark.createDataFrame(rows, "run string, at long, message string, c long, d long, x long")
    clusters = sorted((r["first"], r["central_id"], r["distributed_ids"], r["radio_ids"]) for r in identity.ordered_clusters(frame, "run", "at", "c", "d", "x").collect())
    assert clusters == [(1, 7, [1, 2], [11]), (4, None, [], [12])]
    lives = [(r["at"], r["record"], r["event"], r["c"], r["d"]) for r in identity.lifecycles(frame, "run", "at", "message", ["c", "d", "x"], {"new"}, {"release"}).orderBy("at").collect()]
    assert lives == [(1, 0, "changed", None, 1), (2, 0, "changed", 7, 1), (3, 0, "changed", 7, 2), (4, 1, "changed", None, None), (5, 0, "released", 7, 2), (6, 2, "changed", 7, None)]


def walk_with_unknown_times(a, b, tolerance):
    """Both sides as (t or None, id), those without a time last."""
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    a, b, i, j, out = sorted(a, key=key), sorted(b, key=key), 0, 0, []
    while i < len(a) and j < len(b):
        s, t = a[i][0], b[j][0]
        if s is None or t is None or abs(s - t) <= tolerance:
            out.append((a[i][1], b[j][1]))
            i, j = i + 1, j + 1
        elif s < t:
            out.append((a[i][1], None))
            i += 1
        else:
            out.append((None, b[j][1]))
            j += 1
    return out + [(x, None) for _, x in a[i:]] + [(None, x) for _, x in b[j:]]


def test_pairing_with_unknown_times(spark):
    r = random.Random(11)
    rows, expected, n = ([], []), [], 0
    for key in range(400):
        own = ([], [])
        for side in (0, 1):
            for _ in range(r.randint(0, 6)):
                n += 1
                own[side].append((r.choice([None, *range(0, 40)]) if key % 2 else r.randint(0, 40), n))
            rows[side].extend((key, *x) for x in own[side])
        expected += [(key, *p) for p in walk_with_unknown_times(*own, 5)]
    a, b = (spark.createDataFrame(x, "k int, t bigint, id bigint") for x in rows)
    got = [(x.k, x.a_id, x.b_id) for x in pairing.pair(a, b, ["k"], 5).collect()]
    order = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_issues_by_phrases_and_fragments(spark):
    failures = spark.createDataFrame([(1, "UE context release failed"), (1, "sched"), (2, "no such thing here"), (3, "Timer"), (4, "ab"), (5, "ext release fai")], "failure int, phrase string")
    issues = spark.createDataFrame([(10, "UE context release failed again", "late"), (11, "Other", "the scheduler: ue context  release"), (12, "timers", "x"), (13, None, "timer; and cab"), (14, "", None), (15, "Context Release Failed", "")], "issue int, title string, body string")
    got = sorted((r.failure, r.issue, r.tier, r.nth) for r in rules.match_issues(failures, issues).collect())
    assert got == [(1, 10, 1, 1), (1, 11, 2, 2), (3, 12, 1, 1), (3, 13, 2, 2), (4, 13, 2, 1), (5, 10, 1, 2), (5, 15, 1, 1)]
    assert rules.match_issues(failures.where("false"), issues).count() == 0
    texts = spark.createDataFrame([(1, "Short. A longer phrase here\nA longer phrase here! end"), (2, None)], "k int, text string")
    assert [tuple(r) for r in rules.phrases(texts, "k", "text").collect()] == [(1, "a longer phrase here")]


def test_shared_folder_on_a_cluster():
    assert shared.local_folder("local[4]").startswith("file:///tmp/") and shared.local_folder("local")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.local_folder(master)


def clusters_by_lists(rows):
    """Clusters of (order, central, distributed, radio) rows; the latest cluster that an id points to has it."""
    clusters = []
    for at, c, d, x in sorted(rows):
        if (c, d, x) == (None, None, None):
            continue
        own = None
        for name, v in (("c", c), ("d", d)):
            if own is None and v is not None:
                with_id = [k for k in clusters if v in k[name]]
                own = max(with_id, key=lambda k: k[name][v], default=None)
        if own is None:
            own = {"first": at, "central": None, "c": {}, "d": {}, "x": set()}
            clusters.append(own)
        if own["central"] is None:
            own["central"] = c
        for name, v in (("c", c), ("d", d)):
            if v is not None:
                own[name][v] = at
        if x is not None:
            own["x"].add(x)
    return [(k["first"], k["central"], sorted(k["d"]), sorted(k["x"])) for k in clusters]


def lives_by_lists(rows, new, release):
    active, out, number = [], [], 0
    for at, message, *values in sorted(rows):
        own = {n: v for n, v in enumerate(values) if v is not None}
        if not own:
            continue
        found = None
        for a in active:
            if any(a[1].get(n) == v for n, v in own.items()):
                found = a
                break
        if message == release:
            if found:
                active = [a for a in active if a is not found]
                out.append((at, found[0], "released", *(found[1].get(n) for n in range(3))))
            continue
        if found is None or message == new:
            found = (number, {})
            number += 1
            active.append(found)
        if not all(found[1].get(n) == v for n, v in own.items()):
            found[1].update(own)
            out.append((at, found[0], "changed", *(found[1].get(n) for n in range(3))))
    return out


def test_identity_folds_by_brute_force(spark):
    r = random.Random(21)
    rows = []
    for run in ("a", "b", None):
        for at in r.sample(range(10_000), 300):
            rows.append((run, at, r.choice(["x", "x", "x", "new", "release"]), *(r.choice([None, r.randint(0, 12)]) for _ in range(3))))
    frame = spark.createDataFrame(rows, "run string, at long, message string, c long, d long, x long").repartition(5)
    clusters = [(k.run, k.first, k.central_id, k.distributed_ids, k.radio_ids) for k in identity.ordered_clusters(frame, "run", "at", "c", "d", "x").collect()]
    lives = [tuple(k) for k in identity.lifecycles(frame, "run", "at", "message", ["c", "d", "x"], {"new"}, {"release"}).collect()]
    for run in ("a", "b", None):
        own = [x[1:] for x in rows if x[0] == run]
        assert sorted((k[1:] for k in clusters if k[0] == run), key=repr) == sorted(clusters_by_lists([(at, *ids) for at, _, *ids in own]), key=repr)
        assert sorted((k[1:] for k in lives if k[0] == run), key=repr) == sorted(lives_by_lists(own, "new", "release"), key=repr)
