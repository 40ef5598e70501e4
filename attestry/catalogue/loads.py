"""Load phases and writes over the driver tables: nations and regions as a tree, parts as vocabulary, orders as titles, customers as people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as Z
from ..operators import loads as L
from ..operators import resolve as R
from ..plans.specs import EntitySpec, FieldSpec
from ..sources.readers import table, tables
from ._registry import query
from .claims import EFFECTIVE_SQL, effective


@query(
    """WITH p AS (SELECT DISTINCT r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name FROM region WHERE r_regionkey < 3)
SELECT a.path, len(string_split(a.path, '/'))::BIGINT AS tier, CASE WHEN contains(a.path, '/') THEN string_split(a.path, '/')[1] END AS parent, NOT contains(a.path, '/') OR b.path IS NOT NULL AS parent_known
FROM p a LEFT JOIN p b ON b.path = string_split(a.path, '/')[1] AND contains(a.path, '/')"""
)
def place_tiers(spark, d):
    n, r = tables(spark, d, "nation", "region")
    nations = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    rows = nations.unionByName(r.filter("r_regionkey < 3").select(F.col("r_name").alias("path"))).distinct()
    return L.tiers(rows, "path").withColumn("tier", F.col("tier").cast("bigint"))


@query("SELECT n_nationkey, r_regionkey AS parent_id FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_regionkey = 4 AND false")
def rows_with_parent(spark, d):
    """Terms whose parent is not there are left out with a warning (:func:`rows_without_parent`)."""
    n, r = tables(spark, d, "nation", "region")
    return L.with_parent(n, r.filter("r_regionkey <> 2"), "n_regionkey", "r_regionkey", "r_regionkey")[0].select("n_nationkey", "parent_id")


@query("SELECT 'missing n_regionkey' AS reason, n_regionkey::VARCHAR AS key FROM nation WHERE n_regionkey = 2")
def rows_without_parent(spark, d):
    n, r = tables(spark, d, "nation", "region")
    return L.with_parent(n, r.filter("r_regionkey <> 2"), "n_regionkey", "r_regionkey", "r_regionkey")[1]


@query(
    """SELECT DISTINCT l_orderkey AS id, p_partkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#1'"""
)
def term_edges(spark, d):
    li, p = tables(spark, d, "lineitem", "part")
    rows = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("parts"))
    known = p.filter("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("name"), F.col("p_partkey").alias("id"))
    return L.edges_of(rows, "id", "parts", known, "name")[0]


@query(
    """WITH a AS (SELECT c_custkey AS entity_id, unnest([c_mktsegment, ' ' || c_name || ' ', upper(c_name), '  ']) AS said FROM customer)
SELECT 'person' AS entity_type, entity_id, 'alias' AS field_name, 'alias|alias:' || replace(replace(replace(lower(trim(said)), '%', '%25'), '|', '%7C'), ':', '%3A') AS claim_key,
  '{"alias":"' || lower(trim(said)) || '","display":"' || min(trim(said)) || '","exists":true}' AS value FROM a WHERE trim(said) <> '' GROUP BY entity_id, lower(trim(said))"""
)
def alias_claims(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.array("c_mktsegment", F.concat(F.lit(" "), "c_name", F.lit(" ")), F.upper("c_name"), F.lit("  ")).alias("aliases"))
    return L.alias_claims(c, "person", "c_custkey", "aliases")


@query("SELECT count(DISTINCT CASE WHEN o_custkey IS NULL THEN c_custkey END) AS created, count(DISTINCT CASE WHEN o_custkey IS NOT NULL THEN c_custkey END) AS updated FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def membership_counts(spark, d):
    c, o = tables(spark, d, "customer", "orders")
    return L.membership_counts(c, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def first_of_slug(spark, d):
    return L.first_of_slug(table(spark, d, "part").withColumn("seq", F.col("p_partkey")), "p_brand", "seq")[0].select("p_brand", "p_partkey")


@query(
    """WITH h1 AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), h2 AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A')
SELECT l_suppkey, l_partkey, 'add' AS action FROM (SELECT * FROM h2 EXCEPT SELECT * FROM h1) UNION ALL SELECT l_suppkey, l_partkey, 'remove' FROM (SELECT * FROM h1 EXCEPT SELECT * FROM h2)"""
)
def identifier_sync(spark, d):
    li = table(spark, d, "lineitem")
    return L.set_sync(li.filter("l_returnflag <> 'A'"), li.filter("l_returnflag = 'A'"), ["l_suppkey", "l_partkey"])


@query(
    """WITH ex AS (SELECT o_orderkey AS title_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS external_id, 's' || o_orderkey AS slug FROM orders WHERE o_orderstatus <> 'P'),
inc AS (SELECT o_orderkey AS external_id, CASE o_orderkey % 4 WHEN 0 THEN 's' || o_orderkey WHEN 1 THEN 's' || (o_orderkey + 1) WHEN 2 THEN 'n' || o_orderkey ELSE 's' || o_orderkey END AS slug FROM orders)
SELECT inc.external_id, inc.slug, coalesce(a.title_id, b.title_id) AS title_id, CASE WHEN a.title_id IS NULL AND b.title_id IS NULL THEN 'create' WHEN a.title_id IS NULL OR a.slug = inc.slug THEN 'update'
  WHEN b.title_id IS NOT NULL THEN 'conflict' ELSE 'rename' END AS outcome FROM inc LEFT JOIN ex a ON a.external_id = inc.external_id LEFT JOIN ex b ON b.slug = inc.slug"""
)
def matched_titles(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")

    def slug(prefix, k):
        return F.concat(F.lit(prefix), k.cast("string"))

    existing = o.filter("o_orderstatus <> 'P'").select(key.alias("title_id"), F.when(key % 3 != 0, key).alias("external_id"), slug("s", key).alias("slug"))
    rows = o.select(key.alias("external_id"), F.when(key % 4 == 1, slug("s", key + 1)).when(key % 4 == 2, slug("n", key)).otherwise(slug("s", key)).alias("slug"))
    return L.matched_titles(rows, existing)


@query(
    """SELECT 'parts' AS field, l_partkey::VARCHAR AS value, count(DISTINCT l_orderkey) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 2
UNION ALL SELECT 'makers', l_suppkey::VARCHAR, count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 2"""
)
def vocabulary_offenders(spark, d):
    li, p, s = tables(spark, d, "lineitem", "part", "supplier")
    rows = li.groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("parts"), F.collect_set(F.col("l_suppkey").cast("string")).alias("makers"))
    vocabularies = {"parts": (p.filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("k")), "k"), "makers": (s.filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("k")), "k")}
    return L.vocabulary_check(rows, "l_orderkey", vocabularies)


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 7 ELSE 1 END AS source_id, event_type = 'view' AS late FROM events")
def deferred_claims(spark, d):
    """Claims of one field go to the source of their entity type and are applied last."""
    c = table(spark, d, "events").select("event_id", F.lit("user").alias("entity_type"), F.col("event_type").alias("field_name"), F.lit(1).cast("bigint").alias("source_id"))
    now, late = L.routed(c, "view", spark.createDataFrame([("user", 7), ("title", 8)], "entity_type string, source_id bigint"))
    return now.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).select("event_id", "source_id", "late")


@query("SELECT p_partkey, 'maker' AS type, (p_partkey % 400)::VARCHAR AS key FROM part WHERE p_partkey % 400 NOT IN (SELECT s_suppkey FROM supplier)")
def broken_links(spark, d):
    p, s = tables(spark, d, "part", "supplier")
    texts = p.select("p_partkey", F.format_string("%s by [[maker:%d]], see [[maker:%d|again]]", "p_name", F.col("p_partkey") % 400, F.col("p_partkey") % 400).alias("text"))
    return L.broken_links(texts, "p_partkey", "text", s.select(F.lit("maker").alias("type"), F.col("s_suppkey").cast("string").alias("key")))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def makers_unrepresented(spark, d):
    li, s = tables(spark, d, "lineitem", "supplier")
    return L.unrepresented(li.select("l_suppkey"), "l_suppkey", s.filter("s_acctbal > 0"), "s_suppkey")


@query(
    """WITH n AS (SELECT lower(trim(o_clerk)) AS k, min(trim(o_clerk)) AS name FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN upper('Customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0')) ELSE 'Customer#' || lpad((o_custkey * 2)::VARCHAR, 9, '0') END AS o_clerk FROM orders) GROUP BY 1)
SELECT n.name, min(c_custkey) AS person_id, CASE WHEN min(c_custkey) IS NULL THEN 'person:' || k END AS handle FROM n LEFT JOIN customer ON lower(c_name) = k GROUP BY n.name, k"""
)
def queued_credits(spark, d):
    o, c = tables(spark, d, "orders", "customer")
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    credits = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.upper(name)).otherwise(name).alias("name"))
    return L.queued_names(credits, "name", c, "c_name", "c_custkey")


@query("SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS slug, replace(replace(p_brand, '#', ' '), '-', ' ') AS name FROM part WHERE p_brand <> 'Brand#1'")
def new_terms(spark, d):
    p = table(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"))
    return L.titled_terms(p, "slug", spark.createDataFrame([("brand-1",)], "slug string"))


@query(
    """WITH one AS (SELECT lower(s_name) AS k, min(s_suppkey) AS i FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1), two AS (SELECT lower(c_name) AS k, min(c_custkey) AS i FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1)
SELECT p_partkey, coalesce(one.i, two.i) AS matched_id, CASE WHEN one.i IS NOT NULL THEN 1 WHEN two.i IS NOT NULL THEN 2 END AS matched_by
FROM (SELECT p_partkey, 'SUPPLIER#' || lpad(p_partkey::VARCHAR, 9, '0') AS a, 'customer#' || lpad(p_partkey::VARCHAR, 9, '0') AS b FROM part) LEFT JOIN one ON one.k = lower(a) LEFT JOIN two ON two.k = lower(b)"""
)
def brand_cascade(spark, d):
    p, s, c = tables(spark, d, "part", "supplier", "customer")
    number = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    rows = p.select("p_partkey", F.concat(F.lit("SUPPLIER#"), number).alias("a"), F.concat(F.lit("customer#"), number).alias("b"))
    return L.brand_of(rows, [("a", s, "s_name", "s_suppkey"), ("b", c.filter("c_custkey % 2 = 0"), "c_name", "c_custkey")]).select("p_partkey", "matched_id", "matched_by")


@query(
    """WITH m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'http://x/' || o_orderkey END AS url FROM orders), b AS (SELECT o_custkey, min(o_orderkey) AS i, arg_min(url, o_orderkey) AS u FROM m WHERE url IS NOT NULL GROUP BY 1)
SELECT o_orderkey, coalesce(url, u) AS url, CASE WHEN url IS NOT NULL THEN o_orderkey ELSE i END AS image_from FROM m LEFT JOIN b USING (o_custkey)"""
)
def image_backfill(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("http://x/"), F.col("o_orderkey").cast("string"))).alias("url"))
    return L.backfilled(o, "o_custkey", "o_orderkey", "url").select("o_orderkey", "url", "image_from")


REFERENCES = [Z.Reference("nation", "region_id", "region", True), Z.Reference("customer", "nation_id", "nation", True), Z.Reference("supplier", "nation_id", "nation", False), Z.Reference("order", "customer_id", "customer", False)]
_GONE = """gone AS (SELECT 'region' AS entity, r_regionkey AS id, 0 AS depth FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'nation', n_nationkey, 1 FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT 'customer', c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)"""


def registry(spark, d):
    r, n, c, s, o = tables(spark, d, "region", "nation", "customer", "supplier", "orders")
    return {
        "region": r.select(F.col("r_regionkey").cast("bigint").alias("id")), "nation": n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("region_id")),
        "customer": c.select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_nationkey").cast("bigint").alias("nation_id")), "supplier": s.select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_nationkey").cast("bigint").alias("nation_id")),
        "order": o.select(F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_custkey").cast("bigint").alias("customer_id")),
    }


def region_one(spark):
    return spark.createDataFrame([("region", 1)], "entity string, id bigint")


@query(f"WITH {_GONE} SELECT entity, id, depth, row_number() OVER (ORDER BY depth, entity, id) AS place FROM gone")
def delete_cascade(spark, d):
    """What goes with one region, in a stable order."""
    return Z.deletion(registry(spark, d), REFERENCES, region_one(spark))[0]


@query(
    f"""WITH {_GONE} SELECT 'supplier' AS entity, s_suppkey AS id, 'nation_id' AS "column", 'nation' AS target, s_nationkey AS target_id FROM supplier WHERE s_nationkey IN (SELECT id FROM gone WHERE entity = 'nation')
UNION ALL SELECT 'order', o_orderkey, 'customer_id', 'customer', o_custkey FROM orders WHERE o_custkey IN (SELECT id FROM gone WHERE entity = 'customer')"""
)
def delete_blockers(spark, d):
    return Z.deletion(registry(spark, d), REFERENCES, region_one(spark))[1]


@query(
    """SELECT o_orderkey, o_custkey % 7 = 0 OR c_custkey IS NOT NULL AND c_acctbal >= 0 AS may_restore FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END WHERE o_orderstatus = 'P'"""
)
def restorable_titles(spark, d):
    o, c = tables(spark, d, "orders", "customer")
    rows = o.select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("parent"), F.when(F.col("o_orderstatus") == "P", "deleted").alias("status"))
    parents = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "deleted").alias("status"))
    return Z.restorable_rows(rows, "parent", parents).select("o_orderkey", "may_restore")


_WON = f"{EFFECTIVE_SQL}, w AS (SELECT * FROM ranked WHERE rn = 1)"


@query(
    f"""WITH {_WON}, g AS (SELECT entity_id, max(CASE WHEN claim_key = 'click' THEN value END) AS maker, coalesce(max(CASE WHEN claim_key = 'view' THEN value END), '') AS label FROM w GROUP BY 1)
SELECT g.entity_id, g.label, g.maker, s_suppkey AS maker_id FROM g LEFT JOIN supplier ON s_suppkey::VARCHAR = g.maker"""
)
def resolve_everything(spark, d):
    """Makers first, then what names them, with their ids."""
    user = EntitySpec("user", (FieldSpec("click", "string", target="maker", lookup="slug"), FieldSpec("view", "string", "")))
    maker = EntitySpec("maker", (FieldSpec("slug", preserve=True),))
    before = {"maker": table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_suppkey").cast("string").alias("slug"))}
    done = R.resolve_all(R.winners(effective(spark, d)), [user, maker], before)["user"]
    return done.select("entity_id", F.col("view").alias("label"), F.col("click").alias("maker"), F.col("click_id").alias("maker_id"))


@query(
    f"""WITH {_WON}, now AS (SELECT entity_id, coalesce(max(CASE WHEN claim_key = 'view' THEN value END), '') AS "view" FROM w GROUP BY 1),
t AS (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0 AND event_type = 'view')
SELECT c_custkey AS entity_id, CASE WHEN t.user_id IS NOT NULL THEN coalesce(now."view", '') ELSE 'as it was' END AS "view" FROM customer LEFT JOIN t ON t.user_id = c_custkey LEFT JOIN now ON now.entity_id = c_custkey"""
)
def resolve_touched(spark, d):
    """Only entities of which a resolved field was touched are resolved again."""
    c, e = tables(spark, d, "customer", "events")
    before = c.select(F.col("c_custkey").alias("entity_id"), F.lit("as it was").alias("view"))
    touched = e.filter("event_id % 50 = 0").select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("field_name"))
    spec = EntitySpec("user", (FieldSpec("view", "string", ""),))
    return R.resolve_touched(R.winners(effective(spark, d)), [spec], touched, {"user": before})["user"]
