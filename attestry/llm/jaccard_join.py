"""N-gram Jaccard join: documents whose sets of word shingles are alike, as connected components.

1. Every text becomes its sorted set of shingle hashes (64 bits). Equal sets are one node from here on.
2. Buckets. Two sets with Jaccard of at least p/q differ in at most D = (q - p)/(p + q) of their added sizes. Hash space is cut into
   more than D ranges (by size band, so that both sets are cut alike), so some ranges hold the same shingles on both sides. The
   content of a range is a key; each set keeps its D + 1 strongest keys (most shingles, then hash), which always leaves the
   strongest common one. Nodes that share a key are a bucket; equal buckets are one.
3. Stars. Each node is first compared with the least node of each of its buckets: by count vectors (shingles hashed into ``DIM``
   groups, summed coordinate minima bound the overlap), then, if that bound allows a link, on the sets. Groups of copies fall together here.
4. R-trees. In buckets whose nodes are still apart, count vectors are packed into an R-tree of coordinate-wise maxima; subtrees and
   points below the least overlap are cut. Only what survives goes on: its sets are compared, block by block of bounded size, unless
   already connected. Buckets of more than ``bucket_points`` points are searched chunk pair by chunk pair, so nothing is gathered whole.
5. Components of the verified links give the classes; components of unverified candidates are taken of the tree's survivors only.

Links are not counted per document: copies of a large group link all with all, and steps 3 and 4 leave out pairs that are already connected.

Defined cases: a text without words (null, empty) is linked with nothing and its own class; a text of fewer words than a shingle is one
shingle; a null id never names a class with other ids in it; repeated rows are in one class; extra columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._spark import release, stage
from ._words import SPACE, U64, Words, mix, runs, slices

DIM = 256


class Bands:
    """Size bands: sets that can link lie in one band or in neighbours. ``edges[j]`` cuts the hash space for band j."""

    def __init__(self, p: int, q: int, most: int = 1 << 31):
        self.p, self.q = p, q
        self.low = [1]
        while self.low[-1] < most:
            self.low.append(self.low[-1] * q // p + 1)
        self.cuts: dict[int, tuple[int, np.ndarray]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def cut(self, j: int) -> tuple[int, np.ndarray]:
        """Most differing shingles of two linked sets in this band, and the lower ends of the ranges."""
        if j not in self.cuts:
            differ = (self.q - self.p) * 2 * (self.low[j + 1] - 1) // (self.p + self.q)
            ranges = differ + 2 + -(-3 * differ // 10)
            self.cuts[j] = differ, (np.arange(ranges, dtype=object) * (1 << 64) // ranges).astype(U64)
        return self.cuts[j]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        j = self.of(n)
        run = np.zeros(n + 1, U64)
        np.cumsum(mix(shingles + U64(0x1F)), out=run[1:])
        out = []
        for band in (j, j + 1) if n * self.q // self.p >= self.low[j + 1] else (j,):
            differ, low = self.cut(band)
            if differ == 0:
                continue  # only equal sets
            at = np.append(np.searchsorted(shingles, low), n)
            key = mix((run[at[1:]] - run[at[:-1]]) ^ mix(low + U64(band)))
            # a pair agrees on at least len(low) - differ ranges; without its len(low) - differ - 1 weakest each side still has the strongest of them
            out.append(key[np.lexsort((key, np.diff(at)))[-(differ + 1) :]])
        return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_sets(batch: pa.RecordBatch, k: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted set of each row's shingles."""
    for _, _, data, offsets in slices(batch, "text"):
        words = Words(data, offsets, SPACE, lower)
        hashes = words.hashes()
        all_runs = runs(hashes, k)
        for a, b in zip(words.doc[:-1].tolist(), words.doc[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(all_runs[a : b - k + 1])
            elif b > a:
                yield runs(hashes[a:b], b - a)
            else:
                yield np.zeros(0, U64)


def node_of(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles).sum(dtype=U64) + U64(len(shingles))], U64)).view(np.int64)[0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def counts_of(shingles: np.ndarray) -> bytes:
    """The count vector, one byte a group where no count needs more."""
    counts = np.bincount((shingles & U64(DIM - 1)).astype(np.int64), minlength=DIM)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == DIM else np.uint32).astype(np.int32)


class Seen:
    """Nodes met in this task; forgotten when there are many, as giving the same rows twice does no harm."""

    def __init__(self, most: int = 1_000_000):
        self.nodes: set[int] = set()
        self.most = most

    def new(self, node: int) -> bool:
        if node in self.nodes:
            return False
        if len(self.nodes) > self.most:
            self.nodes.clear()
        self.nodes.add(node)
        return True


def _nodes(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, content, text) to (key, content, n, node, counts)."""
    seen = Seen()
    for batch in batches:
        sets = list(shingle_sets(batch, k, lower))
        nodes = [node_of(s) if len(s) else None for s in sets]
        vectors = [counts_of(s) if node is not None and seen.new(node) else None for node, s in zip(nodes, sets, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("content"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary())], ["key", "content", "n", "node", "counts"]
        )


def _keys(batches: Iterator[pa.RecordBatch], k: int, lower: bool, p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Texts to (k, node) for each key of each node."""
    bands, seen = Bands(p, q), Seen()
    for batch in batches:
        nodes, keys = [], []
        for s in shingle_sets(batch, k, lower):
            if len(s) and seen.new(node := node_of(s)):
                keys.append(bands.keys(s))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["k", "node"])


def _buckets(batches: Iterator[pa.RecordBatch], longest: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node to (bucket, node) of keys with two nodes or more. A bucket is named by its nodes, so that keys of the same
    nodes give one bucket; a key of more than ``longest`` rows is passed on row by row under its own name."""

    def out(buckets: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(buckets), pa.array(nodes)], ["bucket", "node"])

    held, streamed = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
    for batch in itertools.chain(batches, [None]):
        key, node = held if batch is None else (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
        if streamed is not None and len(key):
            n = int(np.searchsorted(key, streamed, side="right"))
            if n:
                yield out(np.full(n, mix(np.array([streamed]).view(U64))[0]), node[:n])
            key, node = key[n:], node[n:]
            streamed = None if len(key) else streamed
        if not len(key):
            held = key, node
            continue
        new = np.append(True, key[1:] != key[:-1])
        other = new | np.append(True, node[1:] != node[:-1])
        key, node, new = key[other], node[other], new[other]
        start = np.flatnonzero(new)
        end = len(key) if batch is None else int(start[-1])
        held = key[end:], node[end:]
        if len(held[0]) > longest:
            streamed = held[0][0]
            yield out(np.full(len(held[0]), mix(np.array([streamed]).view(U64))[0]), held[1])
            held = key[:0], node[:0]
        if end:
            start = start[start < end]
            size = np.diff(np.append(start, end))
            name = mix(np.add.reduceat(mix(node[:end].view(U64)), start) + size.astype(U64))
            several = np.repeat(size > 1, size)
            yield out(np.repeat(name, size)[several], node[:end][several])


class CountTree:
    """R-tree of count vectors, packed by halving along the widest coordinate; inner nodes hold maxima of coordinates and sizes' bounds."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = 16):
        self.counts = counts
        order = [np.arange(len(sizes))]
        while max(map(len, order)) > leaf:
            parts = []
            for part in order:
                if len(part) <= leaf:
                    parts.append(part)
                    continue
                v = counts[part]
                axis = int(np.argmax(v.max(0).astype(int) - v.min(0)))
                half = (len(part) // 2 + leaf - 1) // leaf * leaf if len(part) > 2 * leaf else leaf
                parts += np.split(part[np.argsort(v[:, axis], kind="stable")], [half])
            order = parts
        self.order = np.concatenate(order)
        points, size = counts[self.order], sizes[self.order]
        self.levels = [(points, size, size)]
        while len(self.levels[-1][0]) > leaf:
            v, low, high = self.levels[-1]
            cut = np.arange(0, len(v), leaf)
            self.levels.append((np.maximum.reduceat(v, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
        self.leaf = leaf

    def search(self, counts: np.ndarray, size: int, p: int, q: int) -> np.ndarray:
        """Points whose bound on the overlap reaches the least overlap of a link (the point itself is among them)."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, low, high = self.levels[depth]
            v, low, high = v[at], low[at], high[at]
            bound = np.minimum(v, counts).sum(1, dtype=np.int64)
            # the least size of a partner in the node that can link at all
            partner = np.maximum(low, -(-size * p // q))
            ok = ((p + q) * bound >= p * (size + partner)) & (high * q >= size * p) & (low * p <= size * q)
            at = at[ok]
            if depth:
                at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def roots(m: int) -> tuple[list[int], Callable[[int], int]]:
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    return root, find


def alike(small: np.ndarray, large: np.ndarray, p: int, q: int) -> bool:
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return q * both >= p * (len(small) + len(large) - both)


def link(sets: list[np.ndarray], p: int, q: int, known: list[int], halves: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its component. ``known``: equal numbers are connected already. ``halves``: only pairs of different
    halves are compared (chunk pairs)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = CountTree(np.array([np.bincount((s & U64(DIM - 1)).astype(np.int64), minlength=DIM) for s in sets]).astype(np.int32), sizes)
    counts = tree.counts
    root, find = roots(m)
    first: dict[int, int] = {}
    for i, c in enumerate(known):
        root[i] = first.setdefault(c, i)

    for i in np.argsort(sizes, kind="stable").tolist():
        near = tree.search(counts[i], int(sizes[i]), p, q)
        for j in near.tolist():
            # each pair once, from its larger set
            if (sizes[j], j) >= (sizes[i], i) or (halves is not None and halves[i] == halves[j]):
                continue
            a, b = find(i), find(j)
            if a == b:
                continue
            if alike(sets[j], sets[i], p, q):
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(m)])


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[list]]:
    """Rows sorted by the first ``width`` columns to the other columns of one group after another; a group never holds more than a block."""
    name, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != name:
                if len(rows) > 1:
                    yield [list(c) for c in zip(*rows, strict=True)]
                name, rows = row[:width], []
            rows.append(row[width:])
    if len(rows) > 1:
        yield [list(c) for c in zip(*rows, strict=True)]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _proposals(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, x, y, half, node, known, n, counts) sorted by the first three to edges that connect whatever the R-tree leaves: all
    nodes with a partner in another known class that they might link with. Between two halves, one is the tree and the other searches."""
    for half, node, known, n, counts in _grouped(batches, 3):
        half, known, n = np.array(half), np.array(known), np.array(n)
        v = np.array([vector(c) for c in counts])
        inner = np.arange(len(n))
        if half.any():
            inner, asking = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
            if not len(inner):
                continue
        else:
            # a pair of two classes is found from the smaller one
            of, size = np.unique(known, return_counts=True)
            asking = np.flatnonzero(known != of[np.argmax(size)])
        tree = CountTree(v[inner], n[inner])
        root, find = roots(len(n))
        pairs = []
        for i in asking.tolist():
            for j in inner[tree.search(v[i], int(n[i]), p, q)].tolist():
                if known[i] != known[j] and (a := find(i)) != (b := find(j)):
                    root[max(a, b)] = min(a, b)
                    pairs.append((node[i], node[j]))
        if pairs:
            yield _edges(pairs)


def _links(batches: Iterator[pa.RecordBatch], p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, x, y, half, node, known, shingles) sorted by the first three to edges of each block's verified components."""
    for half, node, known, shingles in _grouped(batches, 3):
        two = np.array(half) if any(half) else None
        first = link([np.frombuffer(s, U64) for s in shingles], p, q, known, two).tolist()
        if pairs := [(node[i], node[j]) for i, j in enumerate(first) if i != j]:
            yield _edges(pairs)


def _spokes(batches: Iterator[pa.RecordBatch], holds: Callable[[bytes, int, bytes, int], bool]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, task, part, node, n, data) sorted by the first three, the hub's own (part 0) first, to the pairs that hold. One hub is in memory."""
    name, own = None, None
    for batch in batches:
        pairs = []
        for hub, task, part, node, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part == 0:
                name, own = (hub, task), (data, n)
            elif name == (hub, task) and holds(*own, data, n):
                pairs.append((node, hub))
        yield _edges(pairs)


def _holding(pairs: DataFrame, data: DataFrame, holds: Callable[[bytes, int, bytes, int], bool], spokes: int = 2000) -> DataFrame:
    """The pairs (a: node, b: hub) whose ``data`` (node, n, data) hold. A hub of many nodes is copied to as many tasks; spokes are streamed."""
    tasks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / spokes).cast("int").alias("c"))
    hubs = tasks.join(data, F.col("b") == F.col("node")).select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("task"), F.lit(0).alias("part"), "node", "n", "data")
    rows = pairs.join(tasks, "b").join(data, F.col("a") == F.col("node"))
    rows = rows.select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("c")).cast("int").alias("task"), F.lit(1).alias("part"), "node", "n", "data")
    dealt = hubs.unionByName(rows).repartition("hub", "task").sortWithinPartitions("hub", "task", "part")
    return dealt.mapInArrow(lambda b: _spokes(b, holds), "a bigint, b bigint")


def _blocks(rows: DataFrame, group: str, weight: Column, limit: int) -> DataFrame:
    """Rows with (x, y, half): a group of more than ``limit`` in weight is cut into chunks by node, and each pair of chunks is a block."""
    chunks = rows.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.sum(weight) / limit).cast("int").alias("_c"))
    placed = rows.join(chunks, F.col(group) == F.col("_g")).withColumn("_mine", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("_c")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    half = F.when(F.col("_mine") > F.col("_other"), 1).otherwise(0)
    return placed.withColumns({"x": F.least("_mine", "_other"), "y": F.greatest("_mine", "_other"), "half": half}).drop("_g", "_c", "_mine", "_other")


def _some_sets(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for s in shingle_sets(batch, k, lower) if len(s)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "data"]
        )


def classes(
    docs: DataFrame, k: int = 5, p: int = 80, q: int = 100, lower: bool = True, text: str = "text", key: str = "doc_id", group_shingles: int = 2_000_000, bucket_points: int = 20_000
) -> DataFrame:
    """One row per row of ``docs``: key, content (hash of the text), n_shingles, component_id (smallest key of the component), class_no (a number
    of the component, which it has without a key too; null without words).

    Links are pairs with q * |A and B| >= p * |A or B| over sets of ``k``-word shingles."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("content"), F.col(f"`{text}`").alias("text"))
    # texts are read and hashed twice, as keys take more room than what they are made of
    keyed = rows.select("text").mapInArrow(lambda b: _keys(b, k, lower, p, q), "k bigint, node bigint").repartition("k").sortWithinPartitions("k", "node")
    buckets = stage(keyed.mapInArrow(_buckets, "bucket bigint, node bigint").distinct(), "buckets")
    del keyed
    release(spark)
    more = T.StructType.fromDDL("n bigint, node bigint, counts binary")
    known = stage(rows.mapInArrow(lambda b: _nodes(b, k, lower), T.StructType([rows.schema["key"], rows.schema["content"], *more])), "nodes")
    inside = buckets.select(F.col("node").alias("_node")).distinct()
    points = known.filter("counts IS NOT NULL").join(inside, F.col("node") == F.col("_node"), "left_semi").select("node", "n", F.col("counts").alias("data")).dropDuplicates(["node"])
    points = stage(points, "points")

    # one row stands for a node, so that its text is found again without moving the others
    first = known.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("key", "content")).alias("one"))
    hashed = rows.select(F.xxhash64("key", "content").alias("h"), "text")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = stage(nodes.join(first, "node").select(F.xxhash64("one.key", "one.content").alias("_h")), "wanted")
        some = hashed.join(wanted, F.col("h") == F.col("_h"), "left_semi").select("text")
        sets = stage(some.mapInArrow(lambda b: _some_sets(b, k, lower), "node bigint, n bigint, data binary").dropDuplicates(["node"]), "sets")
        release(spark, wanted)
        return sets

    def bound(v: bytes, m: int, w: bytes, n: int) -> bool:
        return (p + q) * int(np.minimum(vector(v), vector(w)).sum()) >= p * (m + n) and q * min(m, n) >= p * max(m, n)

    least = buckets.groupBy("bucket").agg(F.min("node").alias("b"))
    stars = buckets.join(least, "bucket").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    stars = stage(_holding(stars, points, bound), "stars")
    release(spark)
    sets = sets_of(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct())
    linked = stage(components(_holding(stars, sets, lambda v, m, w, n: alike(np.frombuffer(v, U64), np.frombuffer(w, U64), p, q))), "linked")
    release(spark, stars, sets)

    # buckets whose nodes are still apart
    apart = buckets.join(linked, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("known"))
    open_ = apart.groupBy("bucket").agg(F.min("known").alias("x"), F.max("known").alias("y")).filter("x <> y").select("bucket")
    searched = _blocks(apart.join(open_, "bucket", "left_semi").join(points, "node"), "bucket", F.lit(1), bucket_points)
    searched = searched.select("bucket", "x", "y", "half", "node", "known", "n", "data").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    near = stage(components(searched.mapInArrow(lambda b: _proposals(b, p, q), "a bigint, b bigint")), "near")
    release(spark, buckets, points)

    sets = sets_of(near.select("node"))
    members = near.withColumnRenamed("root", "grp").join(linked, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("known")).join(sets, "node")
    blocks = _blocks(members, "grp", F.col("n"), group_shingles).select("grp", "x", "y", "half", "node", "known", "data")
    blocks = blocks.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
    late = blocks.mapInArrow(lambda b: _links(b, p, q), "a bigint, b bigint")
    found = stage(components(late.unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))), "links")
    release(spark, near, sets, linked)

    ids = known.filter("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("least"))
    ids = ids.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = ids.join(named, "root").select(F.col("node").alias("_node"), "component_id", F.col("root").alias("class_no"))
    out = known.join(of_node, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), "content", F.col("n").alias("n_shingles"), component.alias("component_id"), "class_no")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of each class with the columns of ``docs``: the smallest key (null after all others), then the least hash of the text, then of the
    whole row. Rows without words have no class and stay, each of them. Texts are shuffled once, by key and hash of the text."""

    def named(id_, content):
        return [F.coalesce(id_.cast("string"), F.lit("")).alias("_id"), F.xxhash64(id_, content).alias("_hash")]

    found = classes(docs, text=text, key=key, **options)
    least = found.filter("class_no IS NOT NULL").groupBy("class_no").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "content")).alias("least"))
    kept = least.select(*named(F.col("least.id"), F.col("least.content")), F.lit(True).alias("_one"))
    kept = kept.unionByName(found.filter("class_no IS NULL").select(*named(F.col(key), F.col("content")), F.lit(False).alias("_one")).distinct())
    # maps can't be hashed as they are
    whole = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), whole.alias("_whole"), *named(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))))
    each = F.when(F.col("_one"), F.lit(0).cast("bigint")).otherwise(F.monotonically_increasing_id()).alias("_each")
    rows = rows.join(kept, ["_id", "_hash"]).select("_id", "_hash", each, "_whole", "_row")
    return rows.groupBy("_id", "_hash", "_each").agg(F.min_by("_row", "_whole").alias("_row")).select("_row.*")
