"""Running sums against plain windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import joins, scans


@pytest.mark.parametrize("tasks", [1, 7, 40])
def test_running_equals_windows(spark, tasks):
    r = random.Random(4)
    keys = [None, "hot", "hot", "hot", "a", "b", "c", ""]
    data = [(r.choice(keys), r.choice([None, 1, 2]), r.randint(0, 50), k, r.choice([None, -3, 0, 1, 5])) for k in range(2000)]
    frame = spark.createDataFrame(data, "k string, j int, t int, id long, v int").repartition(5)
    for key in (["k"], ["k", "j"], []):
        got = scans.running(frame, key, [F.col("t").desc(), "id"], {"total": F.col("v"), "nth": F.lit(1)}, tasks)
        w = Window.partitionBy(*key).orderBy(F.col("t").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
        want = frame.withColumn("total", F.sum(F.coalesce("v", F.lit(0))).over(w)).withColumn("nth", F.row_number().over(w))
        assert got.columns == want.columns
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        before = Window.partitionBy(*key).orderBy(F.col("t").desc(), "id")
        got = scans.previous(frame, key, [F.col("t").desc(), "id"], {"v0": F.col("v"), "row": F.col("id")}, tasks)
        want = frame.withColumn("v0", F.lag("v").over(before)).withColumn("row", F.lag("id").over(before))
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_running_ties_and_empty(spark):
    frame = spark.createDataFrame([("x", 1)] * 300, "k string, t int")
    got = scans.running(frame, ["k"], ["t"], {"nth": F.lit(1)}, 8)
    assert sorted(r["nth"] for r in got.collect()) == list(range(1, 301))
    assert scans.running(frame.limit(0), ["k"], ["t"], {"nth": F.lit(1)}).collect() == []


@pytest.mark.parametrize("hot", [1000, 1])
def test_components_and_roots(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "LEAST_HOT", hot)
    r = random.Random(9)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(60)] + [(7, 7)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        reach = [node]
        while reach:
            x = reach.pop()
            if x not in want:
                want[x] = want.get(node, node)
                reach += near[x]
    got = {x["node"]: x["root"] for x in joins.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    up = {k: k if k % 50 == 0 else max(k - r.choice([1, 1, 7, 40]), k // 50 * 50) for k in range(400)}
    top = lambda k: k if up[k] == k else top(up[k])
    found = joins.roots(spark.createDataFrame(list(up.items()), "node long, up long")).collect()
    assert {x["node"]: x["root"] for x in found} == {k: top(k) for k in up}
    assert joins.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_links_are_contracted_to_nodes(spark, at_once):
    draw = random.Random(at_once)
    pairs = [(g * 100 + draw.randrange(60), g * 100 + draw.randrange(60)) for g in range(-3, 3) for _ in range(400)] + [(999, 999)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(2)
    got = joins.contracted(links, at_once).collect()
    nodes = {x for p in pairs for x in p}
    assert {r.a for r in got} == nodes and all(r.b <= r.a for r in got)
    if at_once > len(pairs):
        assert len(got) <= 2 * len(nodes) < len(set(pairs))  # a node once a task
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    few = {(r.node, r.root) for r in joins.components(spark.createDataFrame(got)).collect()}
    assert few == set(root.items()) == {(r.node, r.root) for r in joins.components(links).collect()}
