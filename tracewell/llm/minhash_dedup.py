"""MinHash near-duplicate detection.

A text's set holds its distinct word shingles.  Texts with equal sets form a class, of
which one member goes on.  Many universal hash minima make a signature; its bands deal the
classes into buckets.  Links are confirmed in two steps, by signature and then on the full
sets, and always with the exact ratio:

1. In every bucket each member is compared with one pivot, the class with most copies.
2. Where a bucket's members are still in several components, those outside its largest one
   (strays) are compared with all members, in tiles of bounded size.  So no link between members
   of a bucket is lost, no group is gathered in one task, and a tile reports only links that join
   what was apart: never all pairs.  With strays of one tile's side, as groups of near copies
   have them, each member goes to one tile, however large the bucket is.
3. Buckets of more strays, such as texts with the same boilerplate, are dealt anew by rare
   shingles: of sets that are near enough, the rarest n - ceil(n * percent / 100) + 1 shingles
   of both have one in common, whatever order "rare" is, so members that share none of these are
   not compared.  Shingles of one component only count as rarest.  Where this would send more
   rows to tiles than the buckets themselves, the buckets stay; either way is exact.

Components come from alternating large-star and small-star passes over the links.

A text with fewer words than a shingle has its whole sequence as its one shingle; one
without words, or null, has an empty set and is linked with nothing.  Repeated rows are in
one class; classes are told apart by 128 bits.  The least id of a component names it; a null
id never does if another is there.  An empty table gives an empty result.  Other columns of
the input are not looked at, whatever their names.  A text of any length is one chunk of a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .tables import map_batches, row_key, store


@dataclass(frozen=True)
class MinHash:
    """With 25 bands of 5, a pair at 0.85 shares no bucket with probability 4e-7."""

    width: int = 5
    percent: int = 85  # linked if 100 * intersection >= percent * union
    bands: int = 25
    rows: int = 5
    tile: int = 128  # members of a tile's side
    tile_shingles: int = 400_000  # of a tile's side, where its sets are large; a larger set is alone
    slack: float = 0.19  # six standard deviations of a signature's estimate at 0.85
    class_bits: int = 64  # of a class's first name

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(5)
        k = self.bands * self.rows
        return r.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints in order, by row, and the rows."""
    low = bt.LOWER[data]
    start, end, rows = bt.words(low, offsets, bt.SPACE)
    prints = bt.word_prints(low, start, end)
    n = len(offsets) - 1
    keys, first = bt.windows(prints, rows, n, width)
    of = rows[first]
    counts = bt.per_row(rows, n)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin, fold = np.searchsorted(rows, short), np.full(len(short), 77, np.uint64)
        for k in range(width - 1):
            there = k < counts[short]
            word = prints[np.minimum(begin + k, len(prints) - 1)]
            fold = np.where(there, bt.mix(fold + word * np.uint64(2 * k + 3)), fold)
        keys, of = np.concatenate([keys, bt.mix(fold + counts[short].astype(np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], of[new]


def minima(keys: np.ndarray, rows: np.ndarray, how: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a set, and their signatures of 32 bits an entry."""
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    out = np.empty((len(at), how.bands * how.rows), np.uint32)
    if len(at):
        for k, (a, b) in enumerate(zip(*how.multipliers())):
            out[:, k] = np.minimum.reduceat(keys * a + b, at) >> np.uint64(32)
    return rows[at], out


def band_keys(signatures: np.ndarray, how: MinHash) -> np.ndarray:
    out = np.empty((len(signatures), how.bands), np.uint64)
    for band in range(how.bands):
        key = np.full(len(signatures), band + 1, np.uint64)
        for k in range(how.rows):
            key = bt.mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, band * how.rows + k])
        out[:, band] = key
    return out


ROW = ["row", "own"]
DIGESTS = "doc_id bigint, row bigint, own bigint, n_shingles bigint, class bigint, check bigint, bands array<bigint>"


def digests(docs: DataFrame, how: MinHash) -> DataFrame:
    """Set size, class (two names, 128 bits together) and band keys of every text."""
    kept = np.uint64(2**how.class_bits - 1)

    def step(batch: pa.RecordBatch) -> pa.Table:
        sizes, classes, checks, bands = [], [], [], []
        for _, data, offsets in bt.chunks(batch.column(3)):
            n = len(offsets) - 1
            keys, rows = shingle_sets(data, offsets, how.width)
            size, name, check = bt.per_row(rows, n), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(name, rows, bt.mix(keys + np.uint64(99)))
            np.add.at(check, rows, bt.mix(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)))
            own, signatures = minima(keys, rows, how)
            each: list = [None] * n
            for r, b in zip(own.tolist(), band_keys(signatures, how).view(np.int64)):
                each[r] = b
            sizes.append(size)
            classes.append((bt.mix(name + size.astype(np.uint64)) & kept).view(np.int64))
            checks.append(check.view(np.int64))
            bands += each
        own = [pa.array(np.concatenate(x)) for x in (sizes, classes, checks)]
        return pa.table([*batch.columns[:3], *own, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", *ROW, "n_shingles", "class", "check", "bands"])

    return map_batches(docs.select("doc_id", *ROW, "text"), step, DIGESTS)


def told_apart(every: DataFrame) -> DataFrame:
    """Different sets that share a class's first name get names of their own; there are next to never any."""
    named = every.where("n_shingles > 0")
    shared = named.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("class", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return every
    own = F.when(F.col("shared"), F.xxhash64("class", "check")).otherwise(F.col("class"))
    return every.join(shared, "class", "left").withColumn("class", own).drop("shared")


SETS = "class bigint, n bigint, signature binary, members binary"


def full_sets(docs: DataFrame, how: MinHash) -> DataFrame:
    """Signature and full set of each row of class and text."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        signatures, members, sizes = [], [], []
        for _, data, offsets in bt.chunks(batch.column(1)):
            keys, rows = shingle_sets(data, offsets, how.width)
            _, own = minima(keys, rows, how)
            signatures += [s.tobytes() for s in own]
            parts = np.split(keys, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
            members += [p.tobytes() for p in parts]
            sizes += [len(p) for p in parts]
        return pa.table([batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(members, pa.binary())], ["class", "n", "signature", "members"])

    return map_batches(docs, step, SETS)


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


LINKS = "a bigint, b bigint"


def confirm(pairs: DataFrame, how: MinHash) -> DataFrame:
    """The pairs whose signatures, and then whose full sets, are near enough."""
    least = (how.percent / 100 - how.slack) * how.bands * how.rows

    def step(batch: pa.RecordBatch) -> pa.Table:
        c = {n: batch.column(n).to_pylist() for n in ("s", "t", "x", "y")}
        ok = [
            (np.frombuffer(s, np.uint32) == np.frombuffer(t, np.uint32)).sum() >= least and linked(x, y, how.percent)
            for s, t, x, y in zip(c["s"], c["t"], c["x"], c["y"])
        ]
        return pa.table([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(pairs, step, LINKS)


TOKENS = "class bigint, comp bigint, n bigint, shingle bigint"


def tokens(sets: DataFrame) -> DataFrame:
    """The shingles of sets (class, comp, n, members), a row each."""

    def step(batch: pa.RecordBatch) -> pa.Table:
        n = batch.column(2).to_numpy()
        each = [pa.array(np.repeat(batch.column(k).to_numpy(), n)) for k in range(3)]
        return pa.table([*each, pa.array(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64))], ["class", "comp", "n", "shingle"])

    return map_batches(sets.select("class", "comp", "n", "members"), step, TOKENS, 64)


def by_rare_shingles(sets: DataFrame, how: MinHash) -> DataFrame:
    """bucket, class, n and comp of sets (class, comp, n, members) that share one of their rarest shingles with another component's."""
    every = tokens(sets)
    seen = every.groupBy("shingle").agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    common = store(seen.where("low <> high").select("shingle", "held"), "common")
    of = every.join(common, "shingle").groupBy("class", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("shared"))
    # the shingles of one component only are the first of the order
    left = (F.expr(f"n - ceil(n * {how.percent} / 100) + 1") - (F.col("n") - F.size("shared"))).cast("int")
    index = of.withColumn("left", left).where("left > 0").select("class", "comp", "n", F.explode(F.slice("shared", F.lit(1), F.col("left"))).alias("s"))
    index = store(index.select(F.col("s.shingle").alias("bucket"), "class", "n", "comp"), "index")
    # shingles with the same members, those of a passage, are one bucket
    same = [F.expr("bit_xor(xxhash64(class))").alias("x"), F.expr("bit_xor(xxhash64(class, 1))").alias("y")]
    members = index.groupBy("bucket").agg(F.count("*").alias("held"), *same, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return store(index.join(members.groupBy("held", "x", "y").agg(F.min("bucket").alias("bucket")), "bucket").select("bucket", "class", "n", "comp"), "rare")


def opened(placed: DataFrame, how: MinHash) -> DataFrame:
    """The buckets whose members (bucket, class, n, comp) are in several components, and the sides of their tiles."""

    def parts(count: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(count / how.tile), F.ceil(shingles / how.tile_shingles)).cast("int")

    by_comp = placed.groupBy("bucket", "comp").agg(F.count("*").alias("held"), F.sum("n").alias("shingles"))
    whole = by_comp.groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("held", "shingles", "comp")).alias("top"), F.sum("held").alias("held"), F.sum("shingles").alias("shingles"))
    held, shingles = F.col("held"), F.col("shingles")
    strays = held - F.col("top.held")
    sides = (F.col("top.comp").alias("main"), held, strays.alias("strays"), parts(strays, shingles - F.col("top.shingles")).alias("down"), parts(held, shingles).alias("across"))
    return whole.where("comps > 1").select("bucket", *sides)


#: Rows that a bucket sends to its tiles.
SENT = "held * down + strays * across"


def tiled(placed: DataFrame, open_: DataFrame) -> DataFrame:
    """bucket, class, comp and tile (i, j, whether as a stray) of members of open buckets: each stray meets each member in one tile."""

    def tile(rows: Column, column: Column, stray: bool) -> Column:
        return F.struct(rows.alias("i"), column.alias("j"), F.lit(stray).alias("stray"))

    i, j = (F.pmod(F.xxhash64(*by), F.col(of)).cast("int") for by, of in ((("class", "bucket"), "down"), (("bucket", "class"), "across")))
    as_member = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda x: tile(x, j, False))
    as_stray = F.when(F.col("comp") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda x: tile(i, x, True))).otherwise(F.array().cast("array<struct<i:int,j:int,stray:boolean>>"))
    return placed.join(open_, "bucket").select("bucket", "class", "comp", F.explode(F.concat(as_stray, as_member)).alias("tile")).select("bucket", "class", "comp", "tile.*")


def apart(placed: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """Tiles of what is still apart in buckets (bucket, class, n, comp)."""
    open_ = store(opened(placed, how), "open")
    many = open_.where("down > 1")
    sent = many.agg(F.sum(F.expr(SENT))).first()[0]
    if not sent:
        return tiled(placed, open_)
    loose = placed.join(many.select("bucket"), "bucket", "left_semi").select("class", "comp").distinct()
    rare = by_rare_shingles(sets.join(loose, "class"), how)
    again = store(opened(rare, how), "open")
    if (again.agg(F.sum(F.expr(SENT))).first()[0] or 0) >= sent:
        return tiled(placed, open_)
    return tiled(placed, open_.where("down = 1")).unionByName(tiled(rare, again))


def tile_links(table: pa.Table, how: MinHash) -> pa.Table:
    """Links between strays and members of a tile that join components; one link is enough for each."""
    names, comps = table.column("class").to_numpy(), table.column("comp").to_numpy()
    strays = np.unique(names[table.column("stray").to_numpy(zero_copy_only=False)])
    names, at = np.unique(names, return_index=True)
    comps = comps[at]
    signatures = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in (table.column("signature")[int(i)] for i in at)])
    sets = [np.frombuffer(table.column("members")[int(i)].as_py(), np.uint64) for i in at]
    n = len(names)
    sizes = np.array([len(s) for s in sets])
    near = np.zeros((n, n), bool)
    for i in np.searchsorted(names, strays).tolist():
        near[i] = (signatures == signatures[i]).sum(1) >= (how.percent / 100 - how.slack) * how.bands * how.rows
    near &= (comps[:, None] != comps[None, :]) & (100 * np.minimum.outer(sizes, sizes) >= how.percent * np.maximum.outer(sizes, sizes))
    used = np.flatnonzero(near.any(0) | near.any(1))
    found = []
    if len(used):
        # shingles that one member has alone cannot be shared
        owner = np.repeat(np.arange(len(used)), sizes[used])
        values, which, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        common = times[which] > 1
        index = (np.cumsum(times > 1) - 1)[which[common]]
        owner, shared = owner[common], np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(index, kind="stable")
        index, owner = index[order], owner[order]
        for low in range(0, int(index[-1]) + 1 if len(index) else 0, 4096):
            a, b = np.searchsorted(index, [low, low + 4096])
            block = np.zeros((len(used), 4096), np.float32)
            block[owner[a:b], index[a:b] - low] = 1
            shared += block @ block.T
        union = sizes[used][:, None] + sizes[used][None, :] - shared
        ok = near[np.ix_(used, used)] & (100 * shared.astype(np.int64) >= how.percent * union.astype(np.int64))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i, j in np.argwhere(ok).tolist():
            p, q = root(int(comps[used[i]])), root(int(comps[used[j]]))
            if p != q:
                parent[p] = q
                found.append((int(names[used[i]]), int(names[used[j]])))
    return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, comp for every node of the links (a, b): the least node that it is connected with."""
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = tuple(state)
        # large-star: a node's greater neighbours go to its least one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = store(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small-star: a node and its lesser neighbours go to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = store(small.where("u <> v").distinct(), "small")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row and own (the row's key and id, not null), n_shingles, component_id and kept for every row."""
    ids = F.col(doc).cast("bigint")
    rows = docs.select(ids.alias("doc_id"), row_key(doc, text).alias("row"), F.coalesce(ids, F.lit(-(2**63))).alias("own"), F.col(text).alias("text"))
    every = told_apart(store(digests(rows, how), "digests"))
    classes = store(
        every.where("n_shingles > 0").groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct(*ROW)).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    dealt = classes.select("class", "n", "copies", F.explode("bands").alias("bucket"))
    buckets = dealt.groupBy("bucket").agg(F.count("*").alias("held"), F.max(F.struct("copies", "class", "n")).alias("pivot")).where("held > 1")
    members = store(dealt.join(buckets, "bucket").select("bucket", "class", "n", "held", F.col("pivot.class").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "members")
    active = members.select("class").distinct().join(classes.select("class", "at.*"), "class")
    texts = rows.join(active, ROW).dropDuplicates(ROW)  # repeated rows share a key
    sets = store(full_sets(texts.select("class", "text"), how), "sets")

    pairs = members.where("class <> pivot").where(f"100 * least(n, pivot_n) >= {how.percent} * greatest(n, pivot_n)").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    one = sets.select(F.col("class").alias("a"), F.col("signature").alias("s"), F.col("members").alias("x"))
    two = sets.select(F.col("class").alias("b"), F.col("signature").alias("t"), F.col("members").alias("y"))
    stars = store(confirm(pairs.join(one, "a").join(two, "b"), how), "stars")
    first = components(stars)

    placed = members.join(first.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", "n", F.coalesce("comp", "class").alias("comp"))
    placed = store(placed, "placed")
    joined = apart(placed, sets, how).join(sets.select("class", "signature", "members"), "class")
    more = joined.groupBy("bucket", "i", "j").applyInArrow(lambda t: tile_links(t, how), LINKS)
    links = stars.unionByName(store(more, "links"))

    final = components(links).withColumnRenamed("node", "class")
    named = classes.select("class", "least").join(final, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    ids = named.groupBy("comp").agg(F.min("least").alias("component"))
    named = named.join(ids, "comp").select("class", "component")
    empty = F.col("n_shingles") == 0
    out = every.select("doc_id", *ROW, "n_shingles", "class").join(named, "class", "left").withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", *ROW, "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
