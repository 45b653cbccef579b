"""Streams against the operators on whole tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import pairing
from tracewell.sources import logs
from tracewell.streaming import stateful


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stateful.state_store(spark)
    yield spark
    spark.conf.set(name, before)


def grown(spark, tmp_path, parts, schema):
    """A stream of the parts, a file each, one a batch."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def until(frame, tmp_path, name, *more):
    """Rows of a query by processing time, once there are as many as asked for; more: numbers of rows and what to do before they are waited for."""
    table, out = None, []
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(processingTime="0.3 seconds").start()
    try:
        for n, before in more:
            before()
            table, end = frame.sparkSession.table(name), time.time() + 90
            while table.count() < n and time.time() < end:
                time.sleep(0.5)
            out.append(table.collect())
        return out
    finally:
        query.stop()


def drained(frame, tmp_path, name):
    query = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return frame.sparkSession.table(name).collect()


def test_stream_of_pairs_equals_batch(rocks, tmp_path):
    r = random.Random(8)
    events = [(r.choice(["x", "x", "y", None]), r.randint(0, 40_000_000), r.randint(0, 1), k) for k in range(400)]
    events += [("y", 5_000_000, s, 1000 + s) for s in (1, 0)] + [("x", 7_000_000, 0, 1003), ("x", 7_000_000, 0, 1002)]
    late = sorted(events, key=lambda e: e[1] + r.randint(0, 4_000_000))  # come up to four seconds late
    parts = [late[k : k + 90] for k in range(0, len(late), 90)] + [[("end", 90_000_000, 0, -1)], [("end", 190_000_000, 0, -2)]]
    stream = grown(rocks, tmp_path, parts, "k string, t long, side int, id long").withColumn("time", F.timestamp_micros("t"))
    found = stateful.pair(stream.where("side = 0"), stream.where("side = 1"), ["k"], 300_000, "5 seconds")
    got = [tuple(x) for x in drained(found, tmp_path, "pairs") if x["k"] != "end"]
    frame = rocks.createDataFrame(events, "k string, t long, side int, id long")
    want = [tuple(x) for x in pairing.pair(frame.where("side = 0"), frame.where("side = 1"), ["k"], 300_000).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(a is not None and b is not None for _, a, b, _, _ in got) > 20


@pytest.mark.parametrize("seed", [1])
def test_stream_of_blocks_equals_batch(rocks, tmp_path, seed):
    r = random.Random(seed)
    header = "2025-01-02T03:04:06.{:06d} [PHY     ] [I] event {}"
    texts = {f: [header.format(k, k) if r.random() < 0.3 else r.choice(["", "  body", "[zmq] x", f"line {k}"]) for k in range(200)] for f in ("a", "b")}
    rows = [(f, k, v) for f, own in texts.items() for k, v in enumerate(own)]
    rows.sort(key=lambda x: (x[1], x[0]))
    cuts = sorted(r.sample(range(len(rows)), 6))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)]) if a < b]
    parts.append([(f, 200, header.format(0, "last")) for f in texts])
    found = stateful.blocks(grown(rocks, tmp_path, parts, "file string, nr long, value string"), logs.RADIO_HEADER, r"^\[zmq", silence=3600)
    whole = rocks.createDataFrame([(f, "\n".join(own)) for f, own in texts.items()], "file string, text string")
    want = logs.blocks(whole, ["file"], "text", logs.RADIO_HEADER, r"^\[zmq").collect()
    (got,) = until(found, tmp_path, f"blocks{seed}", (len(want), lambda: None))
    assert sorted((x["file"], x["block"], x["head"], x["body"], x["n_lines"]) for x in got) == sorted((x["file"], x["block"], x["head"], x["body"], x["n_lines"]) for x in want)
    assert all(texts[x["file"]][x["line"]] == x["head"] for x in got)


def test_silence_ends_a_block(rocks, tmp_path):
    schema = "file string, nr long, value string"
    head = "2025-01-02T03:04:06.000001 [PHY     ] [I] one"
    stream = grown(rocks, tmp_path, [[("a", 0, head), ("a", 1, "body")]], schema)
    found = stateful.blocks(stream, logs.RADIO_HEADER, silence=0.2)
    more = lambda: rocks.createDataFrame([("a", 2, "more")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one, two = until(found, tmp_path, "silent", (1, lambda: None), (2, more))
    assert [tuple(x) for x in one] == [("a", 0, 0, head, ["body"], 2)]
    assert sorted((x["line"], x["block"], x["head"], x["body"], x["n_lines"]) for x in two)[1] == (2, 0, None, ["more"], 1)
