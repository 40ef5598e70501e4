"""Facets over order documents: customer segment and nation, priority, brands and types of lines, year span, price."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import facets as X
from ..operators._shared import shared_dir
from ..operators.facet_index import FacetIndex
from ..sources.readers import table, tables
from ._registry import query

DIMENSIONS = [
    X.Dimension("segment", "segment"), X.Dimension("priority", "priority"), X.Dimension("nation", "nation"), X.Dimension("brands", "brands", "any"), X.Dimension("types", "types", "all"),
    X.Dimension("years", "", "range", ("first_year", "last_year")), X.Dimension("price", "price", "atleast"), X.Dimension("q", "", "text", ("name",)),
]
STATE = X.FilterState({"segment": "BUILDING", "brands": ["Brand#1", "Brand#2", "Brand#3"], "types": ["ECONOMY"], "years": (1996, 2000), "price": 50_000.0})
COUNTED = ["segment", "priority", "nation", "brands", "types"]

_DOCS = """docs AS (SELECT o_orderkey AS k, c_mktsegment AS segment, o_orderpriority AS priority, n_name AS nation, o_totalprice AS price, c_name AS name, brands, types, first_year, last_year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, list(DISTINCT p_brand) AS brands, list(DISTINCT p_type) AS types, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey),
t AS (SELECT *, segment = 'BUILDING' AS f1, coalesce(list_has_any(brands, ['Brand#1', 'Brand#2', 'Brand#3']), false) AS f2, coalesce(list_contains(types, 'ECONOMY'), false) AS f3,
  coalesce(last_year >= 1996 AND first_year <= 2000, false) AS f4, price >= 50000 AS f5 FROM docs)"""
_COUNTS = """SELECT 'segment' AS dimension, segment AS value, count(*) AS n FROM t WHERE f2 AND f3 AND f4 AND f5 GROUP BY 2
UNION ALL SELECT 'priority', priority, count(*) FROM t WHERE f1 AND f2 AND f3 AND f4 AND f5 GROUP BY 2
UNION ALL SELECT 'nation', nation, count(*) FROM t WHERE f1 AND f2 AND f3 AND f4 AND f5 GROUP BY 2
UNION ALL SELECT 'brands', v, count(*) FROM (SELECT unnest(brands) AS v FROM t WHERE f1 AND f3 AND f4 AND f5) GROUP BY 2
UNION ALL SELECT 'types', v, count(*) FROM (SELECT unnest(types) AS v FROM t WHERE f1 AND f2 AND f4 AND f5) GROUP BY 2"""


def documents(spark, d):
    o, c, n, li, p = tables(spark, d, "orders", "customer", "nation", "lineitem", "part")
    lines = li.join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey")
    lines = lines.agg(F.sort_array(F.collect_set("p_brand")).alias("brands"), F.sort_array(F.collect_set("p_type")).alias("types"), F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("n_name").alias("nation"), F.col("o_totalprice").alias("price"),
        F.col("c_name").alias("name"), "brands", "types", "first_year", "last_year",
    )


@query(f"WITH {_DOCS} SELECT k, segment, priority, nation, price, array_to_string(list_sort(brands), ',') AS brands, array_to_string(list_sort(types), ',') AS types, first_year, last_year FROM docs")
def facet_documents(spark, d):
    return documents(spark, d).withColumns({c: F.array_join(c, ",") for c in ("brands", "types")}).drop("name")


@query(f"WITH {_DOCS} SELECT k FROM t WHERE f1 AND f2 AND f3 AND f4 AND f5")
def facet_filter(spark, d):
    return X.filtered(documents(spark, d), DIMENSIONS, STATE).select("k")


@query(f"WITH {_DOCS} {_COUNTS}")
def facet_counts_n1(spark, d):
    return X.counts(documents(spark, d), DIMENSIONS, STATE, COUNTED)


def index(spark, d):
    root = f"{shared_dir(spark)}/attestry-facets-{uuid.uuid4().hex}"
    return FacetIndex(spark, root, DIMENSIONS).build(documents(spark, d), "k")


@query(f"WITH {_DOCS} SELECT k FROM t WHERE f1 AND f2 AND f3 AND f4 AND f5")
def facet_index_filter(spark, d):
    return index(spark, d).keys(STATE).select(F.col("key").alias("k"))


@query(f"WITH {_DOCS} {_COUNTS}")
def facet_index_counts(spark, d):
    """As :func:`facet_counts_n1`, from the bitmaps of a stored index."""
    return index(spark, d).counts(STATE, COUNTED)


@query(
    f"""WITH {_DOCS}, c AS ({_COUNTS}), o AS (SELECT 'segment' AS dimension, segment AS value FROM t UNION SELECT 'priority', priority FROM t UNION SELECT 'nation', nation FROM t
  UNION SELECT 'brands', unnest(brands) FROM t UNION SELECT 'types', unnest(types) FROM t) SELECT dimension, value, coalesce(n, 0) AS n FROM o LEFT JOIN c USING (dimension, value)"""
)
def facet_options(spark, d):
    return X.options(documents(spark, d), DIMENSIONS, STATE, COUNTED)


@query(
    """WITH q AS (SELECT l_orderkey, list(DISTINCT l_quantity::INT) AS qs FROM lineitem GROUP BY 1), b AS (SELECT unnest(list_transform(list_filter(qs, lambda x: x IN (1, 2, 4) OR x >= 6), lambda x: least(x, 6))) AS bucket FROM q)
SELECT bucket, count(*) AS n FROM b GROUP BY 1"""
)
def player_bucket_counts(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("int")).alias("qs"))
    return q.select(F.explode(X.player_buckets(F.col("qs"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("WITH y AS (SELECT p_partkey, min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS z FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) SELECT p_partkey FROM y WHERE z >= 1998 AND a <= 1999")
def interval_overlap(spark, d):
    p, li = tables(spark, d, "part", "lineitem")
    y = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("z"))
    return p.join(y, "p_partkey", "left").filter(X.overlaps(F.col("a"), F.col("z"), 1998, 1999)).select("p_partkey")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'red wid')) OR contains(lower(o_orderpriority), 'red wid')")
def global_search_rollup(spark, d):
    o, li, p = tables(spark, d, "orders", "lineitem", "part")
    lines = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "p_name")
    return X.rolled_up(lines, o, "red wid", ["p_name"], ["o_orderpriority"], "o_orderkey").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '001') OR contains(lower(c_mktsegment), '001')")
def text_search(spark, d):
    return X.matching(table(spark, d, "customer"), "001", ["c_name", "c_mktsegment"]).select("c_custkey")
