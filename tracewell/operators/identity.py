"""Who is who: identifiers that belong to one entity."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import store
from .joins import components, look_up, often_asked, roots
from .scans import previous, running


def first_sightings(frame: DataFrame, primary: str, second: str, order: str) -> DataFrame:
    """One cluster for each primary id, with its first sighting and first second id; a row with a second id only is a cluster of its own."""
    keyed = frame.where(F.col(primary).isNotNull()).groupBy(primary).agg(F.min(order).alias("first"), F.min_by(second, F.when(F.col(second).isNotNull(), F.col(order))).alias(second), F.count("*").alias("n"))
    lone = frame.where(F.col(primary).isNull() & F.col(second).isNotNull()).select(F.col(primary), F.col(order).alias("first"), second, F.lit(1).cast("bigint").alias("n"))
    return keyed.select(primary, "first", second, "n").unionByName(lone)


def ordered_clusters(frame: DataFrame, run: str, order: str, central: str, distributed: str, radio: str) -> DataFrame:
    """Clusters of a run's rows in order: by central id, else by distributed id, else a new one.

    The central id of a cluster is the first it gets; the others are gathered.  Clusters never
    merge, and a row with a radio id only is a new one.

    So all rows with a central id are in the cluster of its first row, and each other row, as
    well as that first one, is in the cluster of the row before it that has its distributed id:
    the clusters are the trees of these pointers, and no run has to be gone through in order.
    """
    named = {"run": run, "at": order, "c": central, "d": distributed, "x": radio}
    rows = frame.select(*(F.col(c).alias(n) for n, c in named.items())).where("c is not null or d is not null or x is not null")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    held = previous(rows.where("d is not null"), ["run", "d"], ["at", "row"], {"c_before": F.col("c"), "row_before": F.col("row")})
    alone = rows.where("d is null").select("*", F.lit(None).cast(dict(rows.dtypes)["c"]).alias("c_before"), F.lit(None).cast("bigint").alias("row_before"))

    def node(c: str, row: str) -> Column:
        return F.struct(F.col("run"), F.col(c).alias("c"), F.when(F.col(c).isNull(), F.col(row)).alias("row"))

    here = held.unionByName(alone).withColumn("node", node("c", "row")).withColumn("before", F.when(F.col("row_before").isNotNull(), node("c_before", "row_before")))
    nodes = here.groupBy("node").agg(F.min_by("before", F.struct("at", "row")).alias("up"), F.min("at").alias("at"), F.collect_set("d").alias("ds"), F.collect_set("x").alias("xs"))
    nodes = store(nodes.withColumn("up", F.coalesce("up", "node")), "nodes")
    found = roots(nodes.select("node", "up")).join(nodes.drop("up"), "node")

    def gathered(lists: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists))))

    first_c = F.min_by("node.c", F.when(F.col("node.c").isNotNull(), F.col("at")))
    clusters = found.groupBy("root").agg(F.min("at").alias("first"), first_c.alias("central_id"), gathered("ds").alias("distributed_ids"), gathered("xs").alias("radio_ids"))
    return clusters.select("root.run", "first", "central_id", "distributed_ids", "radio_ids")


def lifecycles(frame: DataFrame, run: str, order: str, message: str, ids: list[str], new: set[str], release: set[str]) -> DataFrame:
    """Changes of identities over a run: a release ends the first record that shares an id, a new-entity message opens one.

    Other rows join the first active record that shares an id, or open one; an id that a row
    has replaces the record's.  Rows that change nothing are not returned.  Records are numbered
    by run, from 0, as they are opened.

    Rows without an id in common, over any number of others, have nothing to do with each
    other: a run's ids are put into connected components, and each is walked in order of time,
    in a task that holds no more than its open records.
    """
    names = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.xxhash64(run, F.lit(n), n)) for n in ids)))  # ids of one hash only make a component larger
    rows = frame.select(F.col(run).alias("run"), F.col(order).alias("at"), F.col(message).alias("message"), *ids, names.alias("names")).where(F.size("names") > 0)
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("node", F.col("names")[0]), "rows")
    links = rows.select(F.col("node").alias("a"), F.explode("names").alias("b"))
    asked = store(rows.groupBy("node").agg(F.count("*").alias("n")).join(components(links), "node"), "components")
    total = asked.agg(F.sum("n")).first()[0] or 0
    placed = look_up(rows.drop("names"), asked, ["node"], often_asked("n", total))
    dealt = placed.repartition("run", "root").sortWithinPartitions("run", "root", "at", "row").select("run", "root", "at", "row", "message", *ids)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, records = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["run"], r["root"]) != component:
                    component, records = (r["run"], r["root"]), Records(ids, new, release)
                out += records.told(r)
            kinds = {f.name: f.type for f in batch.schema} | {"opened": batch.schema.field("row").type, "event": pa.string()}
            fields = ["run", "at", "row", "opened", "event", *ids]
            yield pa.record_batch([pa.array([x[k] for x in out], kinds[f]) for k, f in enumerate(fields)], fields)

    kinds = dict(rows.dtypes)
    schema = f"run {kinds['run']}, at {kinds['at']}, row bigint, opened bigint, event string, " + ", ".join(f"{n} {kinds[n]}" for n in ids)
    lives = store(dealt.mapInArrow(walked, schema), "lives")
    opened = lives.where("row = opened").select("run", "at", "opened")
    numbers = running(opened, ["run"], ["at", "opened"], {"record": F.lit(1).cast("bigint")})
    return lives.join(numbers.select("opened", (F.col("record") - 1).alias("record")), "opened").select("run", "at", "record", "event", *ids)


class Records:
    """The open records of a component, known by the time and row that opened them."""

    def __init__(self, ids: list[str], new: set[str], release: set[str]):
        self.ids, self.new, self.release = ids, new, release
        self.active: dict = {}  # ids of the open records
        self.holders: dict[tuple, list] = defaultdict(list)  # heaps of the records that had an id

    def first(self, own: dict) -> object:
        found = []
        for n, v in own.items():
            heap = self.holders.get((n, v), [])
            while heap and self.active.get(heap[0], {}).get(n) != v:
                heapq.heappop(heap)  # closed, or has another id now
            found += heap[:1]
            if not heap:
                self.holders.pop((n, v), None)
        return min(found, default=None)

    def told(self, r: dict) -> list[tuple]:
        own = {n: r[n] for n in self.ids if r[n] is not None}
        opened = self.first(own)
        if r["message"] in self.release:
            held = self.active.pop(opened) if opened is not None else None
            return [] if held is None else [(r["run"], r["at"], r["row"], opened[1], "released", *(held.get(n) for n in self.ids))]
        if opened is None or r["message"] in self.new:
            opened = r["at"], r["row"]
            self.active[opened] = {}
        held = self.active[opened]
        if all(held.get(n) == v for n, v in own.items()):
            return []
        held.update(own)
        for item in own.items():
            heapq.heappush(self.holders[item], opened)
        return [(r["run"], r["at"], r["row"], opened[1], "changed", *(held.get(n) for n in self.ids))]
