"""Hierarchies: closures of graphs that may have cycles, roll-ups without double counting, path trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from .bitmaps import positions, sets, sizes, union


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", include_self: bool = True) -> DataFrame:
    """(ancestor, descendant) of a graph of child-parent edges, cycles allowed. Paths double each round, so rounds follow the logarithm of
    the depth; only pairs that are new go into the next round, and each pair is kept once."""
    new = stored(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct(), "closure")
    paths = new

    def joined(upper: DataFrame, lower: DataFrame) -> DataFrame:
        below = lower.select(F.col("ancestor").alias("_via"), F.col("descendant").alias("_to"))
        return upper.join(below, F.col("descendant") == F.col("_via")).select("ancestor", F.col("_to").alias("descendant"))

    while not new.isEmpty():
        longer = joined(new, paths).unionByName(joined(paths, new)).distinct()
        new = stored(longer.join(paths, ["ancestor", "descendant"], "left_anti"), "closure")
        paths = paths.unionByName(new)
    if not include_self:
        return paths.filter("ancestor <> descendant")
    nodes = edges.select(F.col(child).alias("ancestor")).unionByName(edges.select(F.col(parent).alias("ancestor"))).distinct()
    return paths.unionByName(nodes.select("ancestor", F.col("ancestor").alias("descendant"))).distinct()


def rollup_counts(nodes: DataFrame, paths: DataFrame, bridge: DataFrame, node: str, member: str) -> DataFrame:
    """For each node the number of distinct members of it and its descendants; nodes without members count 0.

    Members are bits: those of a node that is asked for are gathered once and go up the paths as bitmaps, those of other nodes go to the ancestors that are
    asked for and are gathered there, before anything is shuffled. What is shuffled are bitmaps by node and bucket, not members by path."""
    asked = nodes.select(F.col(node).alias("_node")).distinct()
    numbers = positions(bridge, member)
    held = bridge.select(F.col(node).alias("descendant"), F.col(member).alias("member")).join(numbers, "member").select("descendant", "number")
    up = paths.join(asked.withColumnRenamed("_node", "ancestor"), "ancestor", "left_semi")
    mine = asked.withColumnRenamed("_node", "descendant")
    through = up.join(mine, "descendant", "left_anti").join(held, "descendant").select("ancestor", "number")
    own = sets(held.join(mine, "descendant", "left_semi"), ["descendant"])
    bits = sets(through, ["ancestor"]).unionByName(up.join(own, "descendant").select("ancestor", "bucket", "bits"))
    counts = sizes(union(bits, ["ancestor"]), ["ancestor"])
    return nodes.select(F.col(node)).join(counts, F.col(node) == F.col("ancestor"), "left").select(node, F.coalesce("members", F.lit(0)).alias("members"))


def expanded(docs: DataFrame, id_: str, values: str, paths: DataFrame) -> DataFrame:
    """Array ``values`` with all ancestors of its members (sorted)."""
    up = paths.select(F.col("descendant").alias("_v"), "ancestor")
    rows = docs.select(id_, F.explode(values).alias("_v")).join(up, "_v", "left").groupBy(id_).agg(F.sort_array(F.collect_set(F.coalesce("ancestor", "_v"))).alias("_all"))
    return docs.join(rows, id_, "left").withColumn(values, F.coalesce("_all", values)).drop("_all")


def makes_cycle(paths: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed (child, parent) edges whose parent is the child itself or below it."""
    down = paths.select(F.col("ancestor").alias("child"), F.col("descendant").alias("parent"))
    below = proposed.join(down, ["child", "parent"], "left_semi")
    return below.unionByName(proposed.filter("child = parent")).distinct()


def strong_components(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, component) of the nodes on a cycle of two nodes or more; a component is named by its largest node.

    Nodes that nothing leads to, or that lead nowhere, are on no cycle and are trimmed first, which leaves little of a hierarchy. In what is left each node takes
    the largest node that leads to it as its colour; what leads back to the node that a colour is named by, within the colour, is its component. Edges
    between colours are on no cycle either, so the rest falls into smaller parts each round."""
    left = stored(edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).filter("a <> b").distinct(), "core")
    found = left.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while True:
        size = None
        while size != (size := left.count()):
            both = left.select(F.col("a").alias("n")).distinct().join(left.select(F.col("b").alias("n")).distinct(), "n", "left_semi")
            left = stored(left.join(both.withColumnRenamed("n", "a"), "a", "left_semi").join(both.withColumnRenamed("n", "b"), "b", "left_semi").select("a", "b"), "core")
        if not size:
            return found
        colours = stored(left.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("colour")), "colours")
        while True:
            sent = left.join(colours.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), F.col("colour").alias("_sent")).groupBy("node").agg(F.max("_sent").alias("_sent"))
            new = stored(colours.join(sent, "node").select("node", F.greatest("colour", "_sent").alias("colour"), (F.col("_sent") > F.col("colour")).alias("_up")), "colours")
            colours = new.select("node", "colour")
            if new.filter("_up").isEmpty():
                break
        within = left.join(colours.select(F.col("node").alias("a"), "colour"), "a").join(colours.select(F.col("node").alias("b"), F.col("colour").alias("_c")), "b")
        within = stored(within.filter(F.col("colour") == F.col("_c")).select("a", "b", "colour"), "within")
        front = members = stored(colours.filter("node = colour"), "members")
        while not front.isEmpty():
            back = within.join(front.select(F.col("node").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct()
            front = stored(back.join(members, ["node", "colour"], "left_anti"), "members")
            members = members.unionByName(front)
        members = stored(members, "members")
        several = members.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = stored(found.unionByName(members.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))), "found")
        gone = members.select("node")
        left = stored(within.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "core")


def joint_cycles(existing: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed (child, parent) edges that are on a cycle of existing and proposed edges together, be it that only several of them close it, and
    edges from a node to itself; with the component."""
    parts = strong_components(existing.select("child", "parent").unionByName(proposed.select("child", "parent")))
    ends = proposed.select("child", "parent").distinct().join(parts.select(F.col("node").alias("child"), "component"), "child").join(parts.select(F.col("node").alias("parent"), F.col("component").alias("_c")), "parent")
    on = ends.filter(F.col("component") == F.col("_c")).filter("child <> parent").select("child", "parent", "component")
    return on.unionByName(proposed.filter("child = parent").select("child", "parent", F.col("child").alias("component")).distinct())


def prefixes(path: Column, sep: str = "/") -> Column:
    """All ancestors of a path and itself, from the root."""
    parts = F.split(path, sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def parent_path(path: Column, sep: str = "/") -> Column:
    return F.when(F.instr(path, sep) > 0, F.regexp_replace(path, f"{sep}[^{sep}]*$", ""))


def depth(path: Column, sep: str = "/") -> Column:
    return F.size(F.split(path, sep))


def division(path: Column, divisions: Column) -> Column:
    """Label of a place by its depth below the country, null beyond the labels."""
    return F.get(divisions, depth(path) - 2)


def compatible(a: Column, b: Column, sep: str = "/") -> Column:
    """Equal, or one an ancestor of the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit(sep))) | b.startswith(F.concat(a, F.lit(sep)))


def path_rollup(rows: DataFrame, path: str, member: str) -> DataFrame:
    """Distinct members of each path and everything below it, as bitmaps; a path whose members are all null has 0."""
    placed = rows.select(F.col(path).alias("_path"), F.col(member).alias("member")).join(positions(rows, member), "member", "left")
    each = placed.select(F.explode(prefixes(F.col("_path"))).alias("path"), "number")
    counts = sizes(sets(each.filter("number IS NOT NULL"), ["path"]), ["path"])
    return each.select("path").distinct().join(counts, "path", "left").select("path", F.coalesce("members", F.lit(0)).alias("members"))


def long_chains(rows: DataFrame, id_: str, parent: str) -> DataFrame:
    """Rows whose parent has a parent: chains of more than one hop."""
    up = rows.select(F.col(id_).alias("_p"), F.col(parent).alias("_pp")).filter("_pp IS NOT NULL")
    return rows.join(up, F.col(parent) == F.col("_p"), "left_semi")
