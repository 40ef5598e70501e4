"""Bitmaps: roll-ups without counting distinct rows, and the facet index against filters over documents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestry.operators import bitmaps as B
from attestry.operators import facets as X
from attestry.operators import hierarchy as Y
from attestry.operators.facet_index import FacetIndex


def test_sets(spark):
    rows = spark.range(400_000).select((F.xxhash64("id") % 3).alias("g"), (F.col("id") % 50_021 + 1).alias("number"))
    of = {r.g: r.members for r in B.sizes(B.sets(rows, ["g"]), ["g"]).collect()}
    assert of == {r.g: r.n for r in rows.groupBy("g").agg(F.countDistinct("number").alias("n")).collect()}
    both = B.intersection(B.sets(rows, ["g"]).withColumn("label", F.col("g")), [], 5)
    shared = rows.groupBy("number").agg(F.countDistinct("g").alias("n")).filter("n = 5").count()
    assert B.sizes(both.withColumn("_", F.lit(0)), ["_"], "n").first()["n"] == shared > 0


def test_rollup_by_bitmaps(spark):
    """A graph with a diamond, a circle, members under several nodes, null members, and a node that nothing is under."""
    rng = random.Random(1)
    edges = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 30) for _ in range(2)] + [("n0", "n5"), ("alone", "alone")]
    bridge = [(f"n{rng.randrange(30)}", rng.choice([None, *range(40)])) for _ in range(200)]
    paths = Y.closure(spark.createDataFrame(edges, "child string, parent string"))
    nodes = [f"n{i}" for i in range(0, 30, 2)] + ["alone", "nowhere"]
    got = Y.rollup_counts(spark.createDataFrame([(n,) for n in nodes], "node string"), paths, spark.createDataFrame(bridge, "node string, m int"), "node", "m")
    below = {}
    for a, d in ((r.ancestor, r.descendant) for r in paths.collect()):
        below.setdefault(a, set()).add(d)
    assert {r.node: r.members for r in got.collect()} == {n: len({m for d, m in bridge if m is not None and d in below.get(n, set())}) for n in nodes}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "Expand" not in plan
    # bitmaps are combined in front of every exchange that follows the paths
    assert plan.count("partial_bitmap_construct_agg") >= 2 and "partial_bitmap_or_agg" in plan


def test_path_rollup_by_bitmaps(spark):
    rows = [("a/b/c", 1), ("a/b", 1), ("a/d", 2), ("e", None), ("a/b/c", 3)]
    got = {r.path: r.members for r in Y.path_rollup(spark.createDataFrame(rows, "path string, m int"), "path", "m").collect()}
    assert got == {"a": 3, "a/b": 2, "a/b/c": 2, "a/d": 1, "e": 0}


DIMENSIONS = [
    X.Dimension("kind", "kind"), X.Dimension("size", "size"), X.Dimension("tags", "tags", "any"), X.Dimension("needs", "tags", "all"), X.Dimension("years", "", "range", ("first", "last")),
    X.Dimension("price", "price", "atleast"), X.Dimension("q", "", "text", ("name",)),
]


def documents(spark, n=700):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        first, last = rng.choice([None, rng.randrange(1950, 2000)]), rng.choice([None, rng.randrange(1980, 2020)])
        tags = rng.choice([None, [], [rng.choice("abcde") for _ in range(rng.randrange(1, 4))]])
        rows.append((f"k{i}", rng.choice(["em", "ss", None]), rng.randrange(4), tags, first, last, rng.choice([None, rng.random() * 100, 50.0]), rng.choice([None, "Star Trek", "Stardust", "other"])))
    return spark.createDataFrame(rows, "k string, kind string, size int, tags array<string>, first int, last int, price double, name string")


def test_index_is_the_filter(spark, tmp_path):
    docs = documents(spark)
    index = FacetIndex(spark, f"file://{tmp_path}/ix", DIMENSIONS).build(docs, "k", bins=8)
    rng = random.Random(7)
    options = {
        "kind": ["em", ["em", "ss"], "none"], "size": [2, [0, 3]], "tags": [["a"], ["b", "e"], ["z"]], "needs": [["a", "b"], ["c"], ["a", "z"]], "years": [(1990, 2005), (None, 1975), (1999, None), (2030, None)],
        "price": [50.0, 0.0, 99.5, 200.0], "q": ["star", "TREK", "nothing"],
    }
    states = [{}] + [{name: rng.choice(options[name]) for name in rng.sample(sorted(options), rng.randrange(1, 4))} for _ in range(9)]
    counted = ["kind", "size", "tags"]
    for chosen in states:
        state = X.FilterState(chosen)
        want = sorted(r.k for r in X.filtered(docs, DIMENSIONS, state).select("k").collect())
        assert sorted(r.key for r in index.keys(state).collect()) == want and index.count(state) == len(want), chosen
        told = {(r.dimension, r.value): r.n for r in X.counts(docs, DIMENSIONS, state, counted).collect()}
        assert {(r.dimension, r.value): r.n for r in index.counts(state, counted).collect()} == told, chosen


def test_index_reads_what_is_named(spark, tmp_path):
    index = FacetIndex(spark, f"file://{tmp_path}/ix", DIMENSIONS).build(documents(spark), "k")
    files = {f.split("/ix/")[1].rsplit("/", 1)[0] for f in index._values("tags", ["a"]).inputFiles()}
    plan = index.one("tags", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "text_name" not in plan
    import pyspark.sql.functions as G

    read = {r.f.split("/ix/")[1].rsplit("/", 1)[0] for r in index._values("tags", ["a"]).select(G.input_file_name().alias("f")).distinct().collect()}
    assert len(read) == 1 and read <= files and next(iter(read)).startswith("values/dimension=tags/part=")
    empty = FacetIndex(spark, f"file://{tmp_path}/none", DIMENSIONS).build(documents(spark).limit(0), "k")
    assert empty.count(X.FilterState({"kind": "em", "years": (1990, None)})) == 0 and empty.counts(X.FilterState(), ["kind"]).count() == 0


def test_state_in_a_url():
    state = X.FilterState({"kind": "em", "tags": ["a b", "c&d"], "years": (1990, None), "price": 12.5})
    query = state.to_query()
    assert query == "kind=em&tags=a+b&tags=c%26d&years_min=1990&price=12.5"
    assert X.FilterState.from_query("?" + query, DIMENSIONS) == state
    assert X.FilterState.from_query("years_min=x&years_max=2000&unknown=1&needs=a", DIMENSIONS).chosen == {"needs": ["a"], "years": (None, 2000)}
    assert X.FilterState.from_query("", DIMENSIONS).to_query() == ""
