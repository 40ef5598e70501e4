"""Enrichment over the driver tables: customers as games, suppliers as persons, lines as the credits that an encyclopedia lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrichment as E
from ..sources.readers import table, tables
from ._registry import query

#: titles in upper case, one customer in four unknown; persons of every fifth supplier unknown; three roles, of which two are known
_WORKS = """w AS (SELECT CASE WHEN o_custkey % 4 <> 0 THEN upper(c_name) ELSE 'Unknown ' || o_custkey END AS title, CASE WHEN l_suppkey % 5 <> 0 THEN s_name ELSE s_name || ' x' END AS person,
  CASE l_returnflag WHEN 'R' THEN 'Design ' WHEN 'A' THEN 'ART' ELSE 'none' END AS role, o_custkey AS m, l_suppkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
o AS (SELECT *, CASE WHEN m % 4 = 0 THEN 'no game' WHEN p % 5 = 0 THEN 'no person' WHEN role = 'none' THEN 'no role' ELSE 'credit' END AS outcome FROM w)"""


def works(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s = tables(spark, d, "lineitem", "orders", "customer", "supplier")
    rows = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    title = F.when(F.col("o_custkey") % 4 != 0, F.upper("c_name")).otherwise(F.concat(F.lit("Unknown "), F.col("o_custkey").cast("string")))
    person = F.when(F.col("l_suppkey") % 5 != 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" x")))
    role = F.when(F.col("l_returnflag") == "R", "Design ").when(F.col("l_returnflag") == "A", "ART").otherwise("none")
    return rows.select(title.alias("title"), person.alias("person"), role.alias("role"))


def games(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))


def matched(spark: SparkSession, d: str) -> DataFrame:
    persons = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    return E.matched_credits(works(spark, d), games(spark, d), persons, spark.range(1).select(F.explode(F.array(F.lit("design"), F.lit("art"))).alias("slug")))


@query(f"""WITH {_WORKS} SELECT DISTINCT m AS entity_id, 'credit|person:' || p || '|role:' || lower(trim(role)) AS claim_key, '{{"exists":true,"person":' || p || ',"role":"' || lower(trim(role)) || '"}}' AS value FROM o WHERE outcome = 'credit'""")
def credit_enrichment(spark, d):
    """Claims of the credits that an encyclopedia lists for known games, persons and roles."""
    return E.credit_claims(matched(spark, d))[0].select("entity_id", "claim_key", "value")


@query(f"WITH {_WORKS} SELECT outcome, count(*) AS works, count(DISTINCT lower(title)) AS games, count(DISTINCT lower(person)) AS persons FROM o GROUP BY 1")
def credit_breakdown(spark, d):
    return E.breakdown(matched(spark, d))


#: persons there are: suppliers by their names, every sixth with a word in front; pages have the names, every tenth one that no work names
_PAGES = f"""{_WORKS}, e AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN 'Old ' || s_name ELSE s_name END AS name FROM supplier WHERE s_suppkey % 6 <> 3),
g AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 7 THEN 'Nobody ' || s_suppkey ELSE s_name END AS title FROM supplier),
c AS (SELECT DISTINCT o_custkey AS m, l_suppkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 48),
n AS (SELECT g.k, min(e.k) AS near FROM g JOIN w ON lower(w.person) = lower(g.title) AND w.m % 4 <> 0 JOIN c ON c.m = w.m JOIN e ON e.k = c.p AND lower(string_split(e.name, ' ')[-1]) = lower(string_split(g.title, ' ')[-1]) GROUP BY 1),
j AS (SELECT g.k, g.title, e.k AS id, near, CASE WHEN lower(g.title) NOT IN (SELECT lower(person) FROM w) THEN 'no credits' WHEN e.k IS NOT NULL THEN 'matched' WHEN near IS NOT NULL THEN 'near duplicate' ELSE 'create' END AS outcome
  FROM g LEFT JOIN e ON lower(e.name) = lower(g.title) LEFT JOIN n ON n.k = g.k)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    s, li, o = tables(spark, d, "supplier", "lineitem", "orders")
    k = F.col("s_suppkey")
    persons = s.filter("s_suppkey % 6 <> 3").select(k.alias("entity_id"), F.when(k % 6 == 0, F.concat(F.lit("Old "), "s_name")).otherwise(F.col("s_name")).alias("name"))
    pages = s.select(k.alias("k"), F.when(k % 10 == 7, F.concat(F.lit("Nobody "), k.cast("string"))).otherwise(F.col("s_name")).alias("title"))
    credits = li.filter("l_quantity >= 48").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("machine_id"), F.col("l_suppkey").alias("person_id"))
    return E.judged_pages(pages, works(spark, d), games(spark, d), persons, credits)


@query(f"WITH {_PAGES} SELECT k, title, id AS person_id, CASE WHEN outcome = 'near duplicate' THEN near END AS near_id, outcome FROM j")
def person_pages(spark, d):
    """What becomes of pages of persons: matched, made, or left out as nobody's or a near duplicate."""
    return judged(spark, d).select("k", "title", "person_id", "near_id", "outcome")


@query(
    f"""WITH {_PAGES}, b AS (SELECT k, title, lower(replace(title, '#', '')) AS base FROM j WHERE outcome = 'create'), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS r FROM b),
t AS (SELECT DISTINCT 'supplier' || lpad(s_suppkey::VARCHAR, 9, '0') AS slug FROM supplier WHERE s_suppkey % 9 = 0)
SELECT k, title, CASE WHEN base IN (SELECT slug FROM t) THEN base || '-' || (r + 1) WHEN r = 1 THEN base ELSE base || '-' || r END AS slug FROM r"""
)
def persons_made(spark, d):
    """New persons with slugs that nobody has."""
    taken = table(spark, d, "supplier").filter("s_suppkey % 9 = 0").select(F.concat(F.lit("supplier"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("slug"))
    return E.new_persons(judged(spark, d), taken, "k").select("k", "title", "slug")


@query(
    """WITH f AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Nobody ' || c_custkey ELSE upper(c_name) END AS name, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer)
SELECT k AS entity_id, 'trade' AS claim_key, segment AS value FROM f WHERE k % 3 <> 0 AND segment IS NOT NULL UNION ALL SELECT k, 'wiki_name', name FROM f WHERE k % 3 <> 0"""
)
def fact_enrichment(spark, d):
    """Facts of a knowledge graph as claims of the entities that their names match."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Nobody "), k.cast("string"))).otherwise(F.upper("c_name"))
    facts = c.select(name.alias("name"), name.alias("wiki_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return E.fact_claims(facts, games(spark, d), {"segment": "trade", "wiki_name": "wiki_name"}, "customer")[0].select("entity_id", "claim_key", "value")
