"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import release, stage


def _contract(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to as many or fewer: each node of a task's edges to the least node that these connect it with. No more than ``most`` nodes
    and a batch are held; beyond, what is known so far is given out and forgotten."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root[top]) != top:
            top = up
        while (up := root[x]) != top:
            root[x], x = top, up
        return top

    def out() -> pa.RecordBatch:
        pairs = np.array([(n, r) for n in root if (r := find(n)) != n], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > most:
            yield out()
            root.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, root): root is the smallest node of the component. Nodes without an edge don't appear.

    Large star: every node sends its larger neighbours to the smallest one; small star: a node and its smaller neighbours go to the smallest
    of them. Edges that meet in a task are contracted there. Rounds end when every node has one partner, a root (the number of rounds
    follows the logarithm of the nodes). Hubs join as skewed keys do."""
    spark = edges.sparkSession

    def staged(rows: DataFrame) -> DataFrame:
        return stage(rows.select("a", "b").distinct().mapInArrow(_contract, "a bigint, b bigint"), "edges")

    now = staged(edges.filter("a <> b"))
    while True:
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("up"), F.lit(1).alias("down")))
        per = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max("down").alias("down"))
        if per.filter("low <> high OR low IS NOT NULL AND down = 1").isEmpty():
            break
        least = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        large = now.join(least, F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        moved = large.join(least, F.col("a") == F.col("node")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = staged(moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))
        release(spark, now)
        now = new
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct().unionByName(roots.select("node", F.col("node").alias("root")))
