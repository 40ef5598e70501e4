"""Lists, aggregates, first rows, pages, intersections and hierarchies over customers, orders, parts and regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import hierarchy as Y
from ..operators._shared import parts_for
from ..sources.readers import table, tables
from ._registry import query


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P'")
def active_filter(spark, d):
    """Status as 'active' (O), null (P) or other."""
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") != "P", "closed")
    return table(spark, d, "orders").filter(A.active(status)).select("o_orderkey")


@query(
    """SELECT p_partkey, p_name, p_size FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 40
  AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)"""
)
def multi_filter_list(spark, d):
    part, li = tables(spark, d, "part", "lineitem")
    conditions = [F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.col("p_type") == "ECONOMY", F.col("p_size").between(5, 40)]
    rows = reduce(lambda df, c: df.filter(c), conditions, part)
    return rows.join(li.filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name", "p_size")


@query("SELECT c_custkey, count(o_orderkey) AS orders, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS top_filled, min(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS first_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def filtered_counts(spark, d):
    c, o = tables(spark, d, "customer", "orders")
    filled, is_open = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(filled).alias("filled"), F.max(F.when(filled, F.col("o_totalprice"))).alias("top_filled"), F.min(F.when(is_open, F.col("o_orderdate"))).alias("first_open")
    )
    return c.select("c_custkey").join(g, "c_custkey", "left").fillna(0, ["orders", "filled"])


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS orders FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def distinct_counts_bridge(spark, d):
    part, li = tables(spark, d, "part", "lineitem")
    pairs = li.select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").join(part.select("p_partkey", "p_brand"), "p_partkey")
    return part.select("p_brand").distinct().join(pairs.groupBy("p_brand").agg(F.countDistinct("l_orderkey").alias("orders")), "p_brand", "left").fillna(0, ["orders"])


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    return A.repeated_names(table(spark, d, "part"), "p_name", "p_partkey").select("name", "n")


#: regions, nations and customers as one graph; a second parent for some nations makes it a DAG, and one edge back a cycle
_EDGES = """edges(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || ((n_regionkey + 1) % 5) FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT 'r0', 'n3')"""


def graph(spark, d):
    n, c = tables(spark, d, "nation", "customer")

    def name(prefix, col):
        return F.concat(F.lit(prefix), col.cast("string"))

    e = n.select(name("n", F.col("n_nationkey")).alias("child"), name("r", F.col("n_regionkey")).alias("parent"))
    e = e.unionByName(c.select(name("c", F.col("c_custkey")).alias("child"), name("n", F.col("c_nationkey")).alias("parent")))
    e = e.unionByName(n.filter("n_nationkey % 4 = 0").select(name("n", F.col("n_nationkey")).alias("child"), name("r", (F.col("n_regionkey") + 1) % 5).alias("parent")))
    return e.unionByName(spark.createDataFrame([("r0", "n3")], "child string, parent string")).distinct()


_CLOSURE = f"WITH RECURSIVE {_EDGES}, up(d, a) AS (SELECT child, parent FROM edges UNION SELECT d, parent FROM up JOIN edges ON a = child)"


@query(f"{_CLOSURE} SELECT DISTINCT a AS ancestor, d AS descendant FROM (SELECT * FROM up UNION SELECT child, child FROM edges UNION SELECT parent, parent FROM edges)")
def transitive_closure(spark, d):
    return Y.closure(graph(spark, d))


@query(
    f"""{_CLOSURE}, al AS (SELECT * FROM up UNION SELECT child, child FROM edges UNION SELECT parent, parent FROM edges)
SELECT k.node, count(DISTINCT o_orderkey) AS members FROM (SELECT DISTINCT a AS node FROM al WHERE a[1] <> 'c') k LEFT JOIN al ON al.a = k.node LEFT JOIN orders ON al.d = 'c' || o_custkey GROUP BY 1"""
)
def dag_rollup_counts(spark, d):
    paths = Y.closure(graph(spark, d))
    nodes = paths.select(F.col("ancestor").alias("node")).distinct().filter("NOT node LIKE 'c%'")
    bridge = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"), "o_orderkey")
    return Y.rollup_counts(nodes, paths, bridge, "node", "o_orderkey")


@query(f"{_CLOSURE} SELECT 'r' || r_regionkey AS child, 'n' || n_nationkey AS parent FROM region, nation WHERE ('n' || n_nationkey, 'r' || r_regionkey) IN (SELECT (d, a) FROM up)")
def cycle_check(spark, d):
    """Every region under every nation, held against the paths: a proposed edge closes a cycle exactly where the nation has the region among its
    ancestors, so the proposals are the paths themselves and no pair is made that can't be one."""
    paths = Y.closure(graph(spark, d))
    r, n = tables(spark, d, "region", "nation")
    regions = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ancestor"))
    nations = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("descendant"))
    proposed = paths.join(regions, "ancestor", "left_semi").join(nations, "descendant", "left_semi").select(F.col("ancestor").alias("child"), F.col("descendant").alias("parent"))
    return Y.makes_cycle(paths, proposed)


#: nations under regions and customers under nations, as they are; proposed are regions under nations and nations under customers, which close cycles only together
_JOINT = """e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
q(child, parent) AS (SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 3 + 1) FROM region UNION SELECT 'n' || n_nationkey, 'c' || (n_nationkey * 7) FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'r4', 'r4')"""


@query(
    f"""WITH RECURSIVE {_JOINT}, al AS (SELECT * FROM e UNION SELECT * FROM q), s AS (SELECT * FROM al WHERE child[1] <> 'c' OR child IN (SELECT parent FROM q)), up(d, a) AS (SELECT child, parent FROM s UNION SELECT d, parent FROM up JOIN s ON a = child)
SELECT child, parent FROM q WHERE child = parent OR (parent, child) IN (SELECT (d, a) FROM up)"""
)
def joint_cycles(spark, d):
    """Proposed edges that are on a cycle of existing and proposed edges together."""
    r, n, c = tables(spark, d, "region", "nation", "customer")

    def edge(rows, child, parent):
        return rows.select(F.concat(F.lit(child[0]), child[1].cast("string")).alias("child"), F.concat(F.lit(parent[0]), parent[1].cast("string")).alias("parent"))

    region, nation = F.col("r_regionkey"), F.col("n_nationkey")
    existing = edge(n, ("n", nation), ("r", F.col("n_regionkey"))).unionByName(edge(c, ("c", F.col("c_custkey")), ("n", F.col("c_nationkey"))))
    proposed = edge(r, ("r", region), ("n", region * 3 + 1)).unionByName(edge(n.filter("n_nationkey % 2 = 0"), ("n", nation), ("c", nation * 7)))
    proposed = proposed.unionByName(edge(r.filter("r_regionkey = 4"), ("r", region), ("r", region)))
    return Y.joint_cycles(existing, proposed).select("child", "parent")


_PATHS = "p AS (SELECT s_suppkey, r_name || '/' || n_name || '/' || (CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def supplier_paths(spark, d):
    s, n, r = tables(spark, d, "supplier", "nation", "region")
    rows = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("s_suppkey", F.concat_ws("/", "r_name", "n_name", F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit")).alias("path"))


@query(f"""WITH {_PATHS} SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, count(DISTINCT s_suppkey) AS members FROM p, range(1, 4) t(i) GROUP BY 1""")
def path_tree_rollup(spark, d):
    return Y.path_rollup(supplier_paths(spark, d), "path", "s_suppkey")


@query(f"""WITH {_PATHS} SELECT s_suppkey, len(string_split(path, '/')) AS depth, array_to_string(string_split(path, '/')[1:2], '/') AS parent, ['region', 'country', 'kind'][len(string_split(path, '/')) - 1] AS label FROM p""")
def path_levels(spark, d):
    labels = F.array(F.lit("region"), F.lit("country"), F.lit("kind"))
    return supplier_paths(spark, d).select("s_suppkey", Y.depth(F.col("path")).cast("bigint").alias("depth"), Y.parent_path(F.col("path")).alias("parent"), Y.division(F.col("path"), labels).alias("label"))


@query("SELECT n_name, count(DISTINCT o) AS orders FROM (SELECT c_nationkey AS k, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey UNION SELECT s_nationkey, l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) JOIN nation ON k = n_nationkey GROUP BY 1")
def inherited_union_counts(spark, d):
    o, c, li, s, n = tables(spark, d, "orders", "customer", "lineitem", "supplier", "nation")
    direct = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"), F.col("o_orderkey").alias("o"))
    through = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("k"), F.col("l_orderkey").alias("o"))
    return direct.unionByName(through).join(F.broadcast(n), F.col("k") == F.col("n_nationkey")).groupBy("n_name").agg(F.countDistinct("o").alias("orders"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_row_per_group(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return g.select("o_custkey", "x.o_orderkey", "x.o_orderdate")


@query("SELECT c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def newest_row_per_group(spark, d):
    o, c = tables(spark, d, "orders", "customer")
    rows = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(A.last_by(F.col("o_orderkey"), F.col("o_orderdate"), -F.col("o_orderkey")).alias("o_orderkey"))


@query("""WITH h AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20), one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)
SELECT o_orderkey, o_custkey FROM one ORDER BY o_orderdate DESC, o_orderkey LIMIT 3""")
def recent_top3_distinct(spark, d):
    return A.top_per_group(table(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 20, "o_custkey", 3).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS status, CASE WHEN count(DISTINCT l_tax) = 1 THEN min(l_tax) END AS tax FROM lineitem GROUP BY 1")
def agreed_values(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(A.agreed(F.col("l_returnflag")).alias("flag"), A.agreed(F.col("l_linestatus")).alias("status"), A.agreed(F.col("l_tax")).alias("tax"))


_BRANDS = "b AS (SELECT o_custkey AS c, o_orderkey AS o, p_brand AS brand, l_tax AS tax FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def bought(spark, d):
    o, li, p = tables(spark, d, "orders", "lineitem", "part")
    n = parts_for(li)  # the joins are dealt over as many
    rows = o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey").join(li.select("l_orderkey", "l_partkey", "l_tax"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(p.select("p_partkey", "p_brand").repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.col("p_brand").alias("brand"), F.col("l_tax").alias("tax"))


@query(f"WITH {_BRANDS}, n AS (SELECT c, count(DISTINCT o) AS n FROM b GROUP BY 1) SELECT c, brand FROM b JOIN n USING (c) GROUP BY c, brand, n HAVING count(DISTINCT o) = n")
def common_set_intersection(spark, d):
    return A.shared_by_all(bought(spark, d), "c", "o", "brand", parts=parts_for(table(spark, d, "lineitem")))


@query(f"WITH {_BRANDS}, n AS (SELECT c, count(DISTINCT o) AS n FROM b GROUP BY 1) SELECT c, brand, CASE WHEN count(DISTINCT tax) = 1 THEN min(tax) END AS tax FROM b JOIN n USING (c) GROUP BY c, brand, n HAVING count(DISTINCT o) = n")
def common_with_payload(spark, d):
    return A.shared_with_payload(bought(spark, d), "c", "o", "brand", "tax", parts=parts_for(table(spark, d, "lineitem")))


@query("WITH s AS (SELECT l_orderkey, l_linestatus, list_sort(list(DISTINCT l_returnflag)) AS s FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, array_to_string(min(s), ',') AS flags FROM s GROUP BY 1 HAVING min(s) = max(s)")
def identical_sets(spark, d):
    return A.identical_sets(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus", "l_returnflag", parts=parts_for(table(spark, d, "lineitem"))).select("l_orderkey", F.array_join("values", ",").alias("flags"))


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 6000) ORDER BY ts DESC, event_id DESC LIMIT 51")
def keyset_page(spark, d):
    t = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events")
    return A.after(e, F.col("ts"), F.col("event_id"), (t, 6000)).select("event_id", "ts")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def offset_page(spark, d):
    return A.page(table(spark, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_custkey", "c_name")


@query("SELECT DISTINCT o_custkey AS c, p_brand AS brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE (o_custkey % 25, p_brand) NOT IN (SELECT (l_suppkey % 25, p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 50)")
def set_minus_scoped(spark, d):
    mine = bought(spark, d).select("c", "brand").distinct().withColumn("g", F.col("c") % 25)
    li, p = tables(spark, d, "lineitem", "part")
    wide = li.filter("l_quantity >= 50").join(p, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") % 25).alias("g"), F.col("p_brand").alias("brand")).distinct()
    return mine.join(wide, ["g", "brand"], "left_anti").select("c", "brand")


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM supplier) AS suppliers")
def site_stats(spark, d):
    one = [table(spark, d, t).select(F.count(F.lit(1))).scalar().alias(n) for n, t in (("customers", "customer"), ("orders", "orders"), ("parts", "part"), ("suppliers", "supplier"))]
    return spark.range(1).select(*one)


@query("SELECT n_name, string_agg(c_name, ' | ' ORDER BY c_custkey) AS search_text FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def search_text(spark, d):
    c, n = tables(spark, d, "customer", "nation")
    rows = c.filter("c_mktsegment = 'BUILDING'").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(A.ordered_structs(F.col("c_custkey"), F.col("c_name")).alias("v"))
    return rows.select("n_name", F.array_join("v.c_name", " | ").alias("search_text"))


@query("SELECT a.s_suppkey, b.s_suppkey AS sibling FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey WHERE a.s_suppkey % 7 = 0 AND b.s_acctbal > 9000")
def sibling_join(spark, d):
    """Pairs of some suppliers and some siblings; :func:`sibling_counts` has the siblings of all."""
    s = table(spark, d, "supplier")
    b = s.filter("s_acctbal > 9000").select("s_nationkey", F.col("s_suppkey").alias("sibling"))
    return s.filter("s_suppkey % 7 = 0").join(b, "s_nationkey").filter("s_suppkey <> sibling").select("s_suppkey", "sibling")


@query("SELECT s_suppkey, s_nationkey, (SELECT count(*) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey) AS siblings FROM supplier a")
def sibling_counts(spark, d):
    """Every supplier, its nation and how many others that nation has; the siblings are the rows of the same nation, so that a nation of n suppliers
    takes n rows and not n * (n - 1)."""
    s = table(spark, d, "supplier")
    g = s.filter("s_nationkey IS NOT NULL").groupBy("s_nationkey").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    return s.select("s_suppkey", "s_nationkey").join(F.broadcast(g), "s_nationkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("siblings", F.lit(0)).alias("siblings"))


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS has_children FROM nation")
def exists_flag(spark, d):
    n, c = tables(spark, d, "nation", "customer")
    has = c.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("has_children")).distinct()
    return n.select("n_nationkey").join(has, "n_nationkey", "left").fillna(False, ["has_children"])


@query("SELECT o_orderkey, n_name, r_name, CASE WHEN c_acctbal > 5000 THEN c_name || ' (' || year(o_orderdate) || ')' ELSE c_name END AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def chain_projection(spark, d):
    o, c, n, r = tables(spark, d, "orders", "customer", "nation", "region")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.when(F.col("c_acctbal") > 5000, F.concat("c_name", F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit(")"))).otherwise(F.col("c_name"))
    return rows.select("o_orderkey", "n_name", "r_name", label.alias("label"))


@query("SELECT p_brand AS person, count(DISTINCT l_orderkey) AS titles, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, p_brand) AS place FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def role_leaderboard(spark, d):
    from pyspark.sql import Window as W

    li, p = tables(spark, d, "lineitem", "part")
    g = li.filter("l_returnflag = 'R'").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("person")).agg(F.countDistinct("l_orderkey").alias("titles"))
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc("titles"), "person")))
