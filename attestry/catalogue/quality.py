"""Data-quality findings over the driver tables: names, duplicates, keys that lead nowhere, unset columns, golden records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators._shared import stored
from ..operators.resolve import related_any, winners
from ..sources.readers import table, tables
from ._registry import query
from .claims import EFFECTIVE_SQL, effective, event_claims


@Q.check("nameless_parts", "error")
def _nameless(t):
    return Q.nameless(t["part"].withColumn("name", F.when(F.col("p_partkey") % 97 != 0, F.col("p_name")).otherwise(" ")), "p_partkey", "name")


@Q.check("users_without_customer", "error")
def _users(t):
    return Q.dangling(t["events"], "user_id", t["customer"].filter("c_custkey % 10 <> 0"), "c_custkey").distinct()


@Q.check("labels_without_document", "warning")
def _labels(t):
    return Q.dangling(t["labels"], "doc_id", t["documents"].filter("doc_id % 10 <> 3"), "doc_id")


@Q.check("same_part_names", "warning")
def _same(t):
    return Q.same_names(t["part"], "p_name")


@Q.check("customers_in_debt_without_segment", "info")
def _unset(t):
    return Q.unset(t["customer"].withColumn("segment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))), "c_custkey", "segment")


@Q.check("own_parent", "error")
def _self(t):
    return Q.self_references(t["nation"], "n_nationkey", "n_regionkey")


_ENTITY_CHECKS = list(Q.CHECKS)


@Q.check("claims_without_entity", "warning")
def _orphaned(t):
    entities = t["customer"].filter("c_custkey % 10 <> 0").select(F.lit("user").alias("entity_type"), F.col("c_custkey").alias("entity_id"))
    return Q.orphaned(t["claims"], entities)


@Q.check("purchases_without_part", "warning")
def _unresolved(t):
    return Q.unresolved(t["won"], "purchase", F.col("value").cast("bigint"), t["part"].filter("p_partkey % 10 <> 1"), "p_partkey")


@Q.check("supplies_without_claim", "info")
def _unclaimed(t):
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    return Q.unclaimed(t["lineitem"], ["l_suppkey", "l_partkey"], t["lineitem"].filter(F.col("l_shipdate") >= cut))


@Q.check("uncurated_customers", "info")
def _uncurated(t):
    return Q.uncurated(t["customer"], "c_custkey", t["claims"], 1, "signup")


@Q.check("variant_chains", "warning")
def _chained(t):
    return Q.chained(t["part"].withColumn("variant_of", F.when(F.col("p_partkey") % 3 == 0, F.expr("p_partkey div 2"))), "p_partkey", "variant_of")


@Q.check("customers_without_pending_order", "warning")
def _childless(t):
    return Q.childless(t["customer"], "c_custkey", t["orders"].filter("o_orderstatus = 'P'"), "o_custkey")


@Q.check("orders_to_review", "info")
def _flagged(t):
    return Q.flagged(t["orders"], "o_orderkey", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))


@Q.check("same_supplier_names", "warning")
def _same_suppliers(t):
    return Q.same_names(t["supplier"].withColumn("name", F.substring("s_name", -1, 1)), "name")


@Q.check("orders_without_year", "info")
def _unset_year(t):
    return Q.unset(t["orders"].withColumn("year", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))), "o_orderkey", "year")


_CLAIM_CHECKS = [n for n in Q.CHECKS if n not in _ENTITY_CHECKS]

_FINDINGS = """f AS (SELECT 'error' AS severity, 'nameless_parts' AS "check", p_partkey::VARCHAR AS subject, 'no name' AS detail FROM part WHERE p_partkey % 97 = 0 OR p_name IS NULL OR trim(p_name) = ''
UNION ALL SELECT DISTINCT 'error', 'users_without_customer', user_id::VARCHAR, 'no such entity' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'warning', 'labels_without_document', doc_id::VARCHAR, 'no such entity' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 3)
UNION ALL SELECT 'warning', 'same_part_names', lower(p_name), count(*) || ' rows' FROM part GROUP BY lower(p_name) HAVING count(*) > 1
UNION ALL SELECT 'info', 'customers_in_debt_without_segment', c_custkey::VARCHAR, 'no segment' FROM customer WHERE c_acctbal < 0 OR c_mktsegment IS NULL
UNION ALL SELECT 'error', 'own_parent', n_nationkey::VARCHAR, 'is its own parent' FROM nation WHERE n_nationkey = n_regionkey)"""
_TABLES = ("part", "events", "customer", "labels", "documents", "nation")


def _found(spark, d):
    return Q.findings(dict(zip(_TABLES, tables(spark, d, *_TABLES), strict=True)), _ENTITY_CHECKS)


@query(f"WITH {_FINDINGS} SELECT * FROM f")
def dq_findings(spark, d):
    return _found(spark, d)


@query(f"""WITH {_FINDINGS}, r AS (SELECT severity, "check", subject, row_number() OVER (PARTITION BY "check" ORDER BY subject) AS r FROM f)
SELECT severity, "check", count(*) AS n, string_agg(subject, ',' ORDER BY subject) FILTER (r <= 5) AS examples FROM r GROUP BY 1, 2""")
def dq_tallies(spark, d):
    return Q.tallies(_found(spark, d)).withColumn("examples", F.array_join("examples", ","))


@query(
    f"""WITH {EFFECTIVE_SQL}, v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 2 END AS up FROM part)
SELECT 'warning' AS severity, 'claims_without_entity' AS "check", entity_id::VARCHAR AS subject, 'claims about a missing user' AS detail FROM claims WHERE entity_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY entity_id
UNION ALL SELECT DISTINCT 'warning', 'purchases_without_part', value, 'no target for purchase' FROM ranked WHERE rn = 1 AND claim_key = 'purchase' AND value IS NOT NULL AND value::BIGINT NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 1)
UNION ALL SELECT 'info', 'supplies_without_claim', l_suppkey || ':' || l_partkey, 'no active claim' FROM lineitem GROUP BY l_suppkey, l_partkey HAVING max(l_shipdate) < TIMESTAMP '1999-01-01'
UNION ALL SELECT 'info', 'uncurated_customers', c_custkey::VARCHAR, 'no curated signup' FROM customer WHERE c_custkey NOT IN (SELECT entity_id FROM claims WHERE source_id = 1 AND claim_key = 'signup')
UNION ALL SELECT 'warning', 'variant_chains', a.k::VARCHAR, 'variant of variant ' || a.up FROM v a JOIN v b ON a.up = b.k WHERE b.up IS NOT NULL
UNION ALL SELECT 'warning', 'customers_without_pending_order', c_custkey::VARCHAR, 'has no rows' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'info', 'orders_to_review', o_orderkey::VARCHAR, 'needs review' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
UNION ALL SELECT 'warning', 'same_supplier_names', lower(right(s_name, 1)), count(*) || ' rows' FROM supplier GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'info', 'orders_without_year', o_orderkey::VARCHAR, 'no year' FROM orders WHERE o_orderstatus = 'P'"""
)
def dq_claim_findings(spark, d):
    """Checks of claims against the catalogue, and of what is materialized against the claims."""
    names = ("part", "customer", "supplier", "orders", "lineitem")
    t = dict(zip(names, tables(spark, d, *names), strict=True))
    return Q.findings(t | {"claims": event_claims(spark, d), "won": winners(effective(spark, d))}, _CLAIM_CHECKS)


@query(
    """SELECT l.doc_id, d.doc_id IS NULL AS orphan FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 10 <> 3) d ON l.doc_id = d.doc_id
WHERE d.doc_id IS NULL UNION ALL SELECT DISTINCT user_id, false FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"""
)
def orphan_and_missing_fk(spark, d):
    labels, docs, events, customers = tables(spark, d, "labels", "documents", "events", "customer")
    orphans = labels.join(docs.filter("doc_id % 10 <> 3"), "doc_id", "left_anti").select("doc_id", F.lit(True).alias("orphan"))
    missing = events.select(F.col("user_id").alias("doc_id")).distinct().join(customers.filter("c_custkey % 10 <> 0"), F.col("doc_id") == F.col("c_custkey"), "left_anti")
    return orphans.unionByName(missing.select("doc_id", F.lit(False).alias("orphan")))


@query(
    """WITH e AS (SELECT p_partkey AS k, 'p_brand' AS field, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#0' ELSE p_brand END AS value FROM part WHERE p_partkey % 50 = 0
  UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT -1, 'p_brand', 'Brand#1')
SELECT k::VARCHAR AS subject, CASE WHEN p_partkey IS NULL THEN 'missing' ELSE field || ' is ' || have || ' not ' || value END AS detail
FROM (SELECT e.*, p_partkey, CASE WHEN field = 'p_brand' THEN p_brand ELSE p_size::VARCHAR END AS have FROM e LEFT JOIN part ON k = p_partkey) WHERE have IS DISTINCT FROM value"""
)
def golden_records(spark, d):
    """Every fiftieth part is expected; :func:`golden_records_all` expects all of them."""
    return _golden(table(spark, d, "part"), "p_partkey % 50 = 0")


@query(
    """WITH e AS (SELECT p_partkey AS k, 'p_brand' AS field, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#0' ELSE p_brand END AS value FROM part
  UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT -1, 'p_brand', 'Brand#1')
SELECT k::VARCHAR AS subject, CASE WHEN p_partkey IS NULL THEN 'missing' ELSE field || ' is ' || have || ' not ' || value END AS detail
FROM (SELECT e.*, p_partkey, CASE WHEN field = 'p_brand' THEN p_brand ELSE p_size::VARCHAR END AS have FROM e LEFT JOIN part ON k = p_partkey) WHERE have IS DISTINCT FROM value"""
)
def golden_records_all(spark, d):
    return _golden(table(spark, d, "part"), "true")


def _golden(p, expected_parts):
    spark = p.sparkSession
    chosen = p.filter(expected_parts).select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "Brand#0").otherwise(F.col("p_brand")).alias("p_brand"), F.col("p_size").cast("string").alias("p_size"))
    expected = chosen.unpivot("p_partkey", ["p_brand", "p_size"], "field", "value").withColumnRenamed("p_partkey", "k")
    expected = expected.unionByName(spark.createDataFrame([(-1, "p_brand", "Brand#1")], "k bigint, field string, value string"))
    return Q.golden(p.withColumnRenamed("p_partkey", "k"), "k", expected, ["p_brand", "p_size"]).select(F.col("subject").cast("string").alias("subject"), "detail")


@query(
    """SELECT DISTINCT 'warning' AS severity, 'credits_without_person' AS "check", l_suppkey::VARCHAR AS subject, 'no target for credit' AS detail FROM lineitem WHERE l_suppkey % 10 = 3
UNION ALL SELECT DISTINCT 'warning', 'credits_without_role', l_returnflag, 'no target for credit' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
UNION ALL SELECT DISTINCT 'info', 'credits_without_claim', l_orderkey || ':' || l_suppkey || ':' || l_returnflag, 'no active claim' FROM lineitem WHERE (l_orderkey, l_suppkey, l_returnflag) NOT IN (SELECT (l_orderkey, l_suppkey, l_returnflag) FROM lineitem WHERE l_quantity >= 3)
UNION ALL SELECT DISTINCT 'info', 'uncurated_orders', l_orderkey::VARCHAR, 'no curated credit' FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 4 = 1)"""
)
def dq_relationship_findings(spark, d):
    """Checks of relationship claims by their JSON: persons and roles that there are not, credits that nobody claims, orders that the curating source says nothing of."""
    li, s = tables(spark, d, "lineitem", "supplier")
    value = F.to_json(F.struct((F.col("l_quantity") >= 3).alias("exists"), F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("role")))
    key = F.concat_ws("|", F.lit("credit"), F.concat(F.lit("person:"), F.col("l_suppkey").cast("string")), F.concat(F.lit("role:"), F.col("l_returnflag")))
    claims = li.select(F.col("l_orderkey").alias("entity_id"), F.lit("credit").alias("field_name"), key.alias("claim_key"), value.alias("value"), (F.col("l_suppkey") % 4).alias("source_id"), F.lit(True).alias("is_active"))
    claims = stored(claims, "claims")  # the checks read them, so that their JSON is written once
    credits = li.select(F.col("l_orderkey").alias("entity_id"), F.col("l_suppkey").alias("person"), F.col("l_returnflag").alias("role"))
    said = related_any(claims.withColumn("entity_type", F.lit("order")), "credit", {"person": "bigint", "role": "string"})
    orders = li.select("l_orderkey").distinct()
    person, role = F.get_json_object("value", "$.person"), F.get_json_object("value", "$.role")
    parts = [
        ("warning", "credits_without_person", Q.unresolved(claims, "credit", person, s.filter("s_suppkey % 10 <> 3").select(F.col("s_suppkey").cast("string").alias("k")), "k")),
        ("warning", "credits_without_role", Q.unresolved(claims, "credit", role, li.filter("l_returnflag IN ('A', 'R')").select(F.col("l_returnflag").alias("k")).distinct(), "k")),
        ("info", "credits_without_claim", Q.unclaimed(credits, ["entity_id", "person", "role"], said)),
        ("info", "uncurated_orders", Q.uncurated(orders, "l_orderkey", claims, 1, "credit")),
    ]
    out = None
    for severity, check, rows in parts:
        found = Q.finding(rows, severity, check, F.col("subject"), F.col("detail"))
        out = found if out is None else out.unionByName(found)
    return out
