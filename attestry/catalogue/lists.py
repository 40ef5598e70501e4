"""Lists, documents and details over the driver tables: suppliers as makers, customers as people, orders as titles, lines as models, parts as terms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import display as D
from ..operators import aggregates as A
from ..operators import facets as X
from ..operators import lists as I
from ..sources.readers import table, tables
from ._registry import query


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL OR nullif(o_orderpriority, '5-LOW') IS NOT NULL")
def either_unset_or_set(spark, d):
    variant, converted = F.nullif(F.col("o_orderstatus"), F.lit("O")), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return table(spark, d, "orders").filter(variant.isNull() | converted.isNotNull()).select("o_orderkey")


@query("SELECT c_custkey, c_name, place FROM customer JOIN (VALUES (7, 1), (3, 2), (100, 3), (42, 4)) w(id, place) ON c_custkey = id")
def rows_in_given_order(spark, d):
    return A.by_ids(table(spark, d, "customer"), "c_custkey", [7, 3, 100, -5, 42]).select("c_custkey", "c_name", "place")


@query(
    """SELECT event_id, user_id, coalesce(c_name, '') AS name, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events LEFT JOIN customer ON c_custkey = user_id
WHERE event_id % 11 = 0 AND event_type <> 'click' QUALIFY place <= 100"""
)
def review_queue(spark, d):
    """Active claims that need review, newest first, with the name of what they are about: the first hundred are the page."""
    e, c = tables(spark, d, "events", "customer")
    rows = e.withColumns({"is_active": F.col("event_type") != "click", "needs_review": F.col("event_id") % 11 == 0}).filter("is_active AND needs_review")
    first = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    named = first.join(c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), "user_id", "left")
    place = F.row_number().over(W.orderBy(F.desc("ts"), F.desc("event_id")))  # a hundred rows
    return named.select("event_id", "user_id", F.coalesce("name", F.lit("")).alias("name"), place.alias("place"))


@query("""SELECT s_suppkey, CASE WHEN n_nationkey % 3 <> 0 THEN '{"slug":"n' || n_nationkey || '","name":"' || n_name || '"}' END AS maker FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def struct_refs(spark, d):
    s, n = tables(spark, d, "supplier", "nation")
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    slug = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    return rows.select("s_suppkey", F.to_json(D.reference(slug, F.col("n_name"))).alias("maker"))


@query("SELECT n_nationkey AS value, n_name AS label, row_number() OVER (ORDER BY n_regionkey, lower(n_name), n_nationkey) AS place FROM nation")
def edit_options(spark, d):
    return D.options(table(spark, d, "nation"), "n_nationkey", "n_name", "n_regionkey")


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 50 OFFSET 50")
def named_order(spark, d):
    orders = {"name": [F.col("p_name"), F.col("p_partkey")], "size": [F.desc("p_size"), F.col("p_name"), F.col("p_partkey")], "brand": [F.col("p_brand"), F.col("p_partkey")]}
    return A.page(table(spark, d, "part"), D.orderings(orders, "size", "name"), 2).select("p_partkey", "p_name", "p_size")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20")
def typeahead(spark, d):
    """An unknown order falls back to the name; the first twenty are the feature."""
    orders = {"name": [F.col("p_name"), F.col("p_partkey")]}
    return table(spark, d, "part").orderBy(*D.orderings(orders, "no such order", "name")).limit(20).select("p_partkey", "p_name")


@query("SELECT n_regionkey, n_name, count(c_custkey) AS customers, row_number() OVER (PARTITION BY n_regionkey ORDER BY count(c_custkey) DESC, n_name) AS place FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def tree_children(spark, d):
    n, c = tables(spark, d, "nation", "customer")
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    rows = n.join(counts, "n_nationkey", "left").select("n_regionkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))
    return I.by_size(rows, ["n_regionkey"], "customers", "n_name")


@query(
    """SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS year,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END DESC NULLS LAST, o_orderkey) AS place FROM orders"""
)
def newest_year_first(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("year"))
    return I.by_year(o, ["o_custkey"], "year", "o_orderkey")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_edits(spark, d):
    return I.newest(table(spark, d, "events"), "ts", "event_id", 50).select("event_id", "user_id")


@query("SELECT 'customer' AS origin, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def labelled_union(spark, d):
    return A.labelled({o: table(spark, d, o).select(F.col(k).cast("bigint").alias("id"), F.col(n).alias("name")) for o, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))})


@query("SELECT c_nationkey, count(DISTINCT CAST(ts AS DATE)) AS changesets FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def touched_changesets(spark, d):
    """Changesets (days) that touch any entity of a set, set by set (customers of a nation)."""
    e, c = tables(spark, d, "events", "customer")
    return I.touching(e.select(F.col("user_id").alias("c_custkey"), F.to_date("ts").alias("day")), c, "c_custkey", "c_nationkey", "day")


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY 1, 2)")
def numbers_by_appearance(spark, d):
    """Each kind numbered by when it first appears in a user's list."""
    return I.numbered_by_appearance(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'fail' WHEN s.s_suppkey IS NULL THEN 'orphan' WHEN p.p_partkey IS NULL THEN 'unmatched' ELSE 'ok' END AS state
FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey % 300 LEFT JOIN part p ON p.p_partkey = s.s_suppkey * 7"""
)
def alias_states(spark, d):
    """Aliases by what is known of their parent: no key at all, parent missing, parent without a counterpart, fine."""
    c, s, p = tables(spark, d, "customer", "supplier", "part")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 4 != 3, F.col("c_custkey") % 300).alias("parent"))
    return I.alias_states(rows, "parent", s.withColumn("other", F.col("s_suppkey") * 7), "s_suppkey", "other", p, "p_partkey").select("c_custkey", "state")


@query(
    """SELECT c_custkey, s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence
FROM customer JOIN supplier ON lower(replace(c_name, 'Customer', '')) = lower(replace(s_name, 'Supplier', ''))"""
)
def name_confidence(spark, d):
    c, s, o = tables(spark, d, "customer", "supplier", "orders")
    busy = o.select(F.col("o_custkey").alias("c_custkey"))
    bare = [F.replace(n, F.lit(x), F.lit("")) for n, x in (("c_name", "Customer"), ("s_name", "Supplier"))]
    return I.name_confidence(c, s, *bare, busy, "c_custkey").select("c_custkey", "s_suppkey", "confidence")


@query(
    """WITH p AS (SELECT *, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p, lag(o_shippriority) OVER w AS h, lag(o_orderkey) OVER w AS k FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'x' END AS o_shippriority
  FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, concat_ws(',', CASE WHEN nullif(h, '') IS DISTINCT FROM nullif(o_shippriority, '') THEN 'note' END, CASE WHEN p IS DISTINCT FROM o_orderpriority THEN 'priority' END, CASE WHEN s IS DISTINCT FROM o_orderstatus THEN 'status' END) AS changed FROM p WHERE k IS NOT NULL"""
)
def changed_fields(spark, d):
    """Fields in which an order differs from the customer's one before; blank is the same as unset."""
    note = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 2, "x")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    now = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "note": F.col("note")}
    o = table(spark, d, "orders").withColumn("note", note).withColumns({f"was_{n}": F.lag(c).over(w) for n, c in now.items()} | {"was": F.lag("o_orderkey").over(w)})
    return o.filter("was IS NOT NULL").select("o_orderkey", F.array_join(D.changed({n: F.col(f"was_{n}") for n in now}, now), ",").alias("changed"))


@query(
    """SELECT o_orderkey, o_orderstatus <> 'F' AND count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) OVER w = 1 AND count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER w = 0 AS only_base FROM orders WINDOW w AS (PARTITION BY o_custkey)"""
)
def single_base(spark, d):
    """The one base of its group: no variant itself, the only base, and no variants beside it."""
    return I.only_base(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F").select("o_orderkey", "only_base")


@query(
    """SELECT s_suppkey, n_name, r_name, count(DISTINCT l_orderkey) AS titles, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year, lower(s_name || ' | ' || n_name) AS search_text,
  arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS newest_part
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, n_name, r_name"""
)
def maker_documents(spark, d):
    s, n, r, li = tables(spark, d, "supplier", "nation", "region", "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.countDistinct("l_orderkey").alias("titles"), F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"),
        F.max_by("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("newest_part"),
    )
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).join(g, "s_suppkey", "left")
    return rows.select("s_suppkey", "n_name", "r_name", F.coalesce("titles", F.lit(0)).alias("titles"), "first_year", "last_year", F.lower(F.concat_ws(" | ", "s_name", "n_name")).alias("search_text"), "newest_part")


@query(
    """WITH docs AS (SELECT s_suppkey, r_name, n_name, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS kind, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT *, r_name IN ('ASIA', 'EUROPE') AS f1, kind = 'credit' AS f2, s_acctbal >= 1000 AS f3 FROM docs)
SELECT 'region' AS dimension, r_name AS value, count(CASE WHEN f2 AND f3 THEN 1 END) AS n FROM m GROUP BY 2 UNION ALL
SELECT 'kind', kind, count(CASE WHEN f1 AND f3 THEN 1 END) FROM m GROUP BY 2 UNION ALL SELECT 'nation', n_name, count(CASE WHEN f1 AND f2 AND f3 THEN 1 END) FROM m GROUP BY 2"""
)
def maker_facets(spark, d):
    """Counts of each value under all filters but its own dimension's; values that count nothing stay."""
    s, n, r = tables(spark, d, "supplier", "nation", "region")
    docs = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    docs = docs.withColumn("kind", F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit"))
    dimensions = [X.Dimension("region", "r_name"), X.Dimension("kind", "kind"), X.Dimension("nation", "n_name"), X.Dimension("worth", "s_acctbal", "atleast")]
    return X.options(docs, dimensions, X.FilterState({"region": ["ASIA", "EUROPE"], "kind": "credit", "worth": 1000}), ["region", "kind", "nation"])


@query(
    """SELECT c_custkey, count(DISTINCT o_orderkey) AS titles, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS credits, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def people_documents(spark, d):
    c, o = tables(spark, d, "customer", "orders")
    g = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderkey").alias("titles"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("credits"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))
    return c.select("c_custkey").join(g, "c_custkey", "left").fillna(0, ["titles", "credits"])


@query(
    """SELECT r_name AS name, string_agg(n_name || ':' || coalesce(k, 0), ',' ORDER BY n_name) AS children, sum(coalesce(k, 0))::BIGINT AS titles
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(DISTINCT o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1"""
)
def nested_taxonomy(spark, d):
    r, n, c, o = tables(spark, d, "region", "nation", "customer", "orders")
    k = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("o_orderkey").alias("k"))
    rows = n.join(k, "n_nationkey", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    child = F.struct(F.col("n_name").alias("name"), F.col("k").alias("k"))
    g = rows.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(child)).alias("children"), F.sum("k").alias("titles"))
    text = F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["name"], x["k"].cast("string"))), ",")
    return r.join(g, "r_regionkey", "left").select(F.col("r_name").alias("name"), text.alias("children"), "titles")


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem),
x AS (SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS status, count(*) AS models,
  string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS makers FROM m GROUP BY 1)
SELECT x.*, count(DISTINCT b.l_orderkey) AS linked FROM x LEFT JOIN m a ON a.l_orderkey = x.l_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM m) b ON b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_orderkey <> a.l_orderkey GROUP BY ALL"""
)
def title_detail(spark, d):
    """A title with what all of its models agree on, its makers, and how many other titles have a model of the same part and maker."""
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").distinct()
    g = m.groupBy("l_orderkey").agg(A.agreed(F.col("l_returnflag")).alias("flag"), A.agreed(F.col("l_linestatus")).alias("status"), F.count(F.lit(1)).alias("models"), F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("makers"))
    mine = m.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    theirs = mine.withColumnRenamed("l_orderkey", "other")
    linked = mine.join(theirs, ["l_partkey", "l_suppkey"]).filter("other <> l_orderkey").groupBy("l_orderkey").agg(F.countDistinct("other").alias("linked"))
    return g.join(linked, "l_orderkey", "left").fillna(0, ["linked"])


@query(
    """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS siblings, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, c_mktsegment) AS generation, n_name AS franchise
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
)
def model_detail(spark, d):
    """A model with the number of its siblings, a trait of its own or else its title's, and the franchise through the title."""
    o, c, n = tables(spark, d, "orders", "customer", "nation")
    titles = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    per = o.groupBy("o_custkey").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    rows = o.join(per, "o_custkey").join(titles, "o_custkey")
    return rows.select("o_orderkey", "siblings", F.coalesce(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), F.col("c_mktsegment")).alias("generation"), F.col("n_name").alias("franchise"))


@query(
    """SELECT n_name AS name, count(DISTINCT o_orderkey) AS titles, min(year(o_orderdate)) AS first_year, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_title
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def series_list(spark, d):
    n, c, o = tables(spark, d, "nation", "customer", "orders")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = rows.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("o_orderkey").alias("titles"), F.min(F.year("o_orderdate")).alias("first_year"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_title"))
    return n.join(g, "n_nationkey", "left").select(F.col("n_name").alias("name"), F.coalesce("titles", F.lit(0)).alias("titles"), "first_year", "first_title")
