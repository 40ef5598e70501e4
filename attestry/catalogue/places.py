"""Writes of places over the driver tables: regions are countries, nations and customers the levels below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places as P
from ..sources.readers import tables
from ._registry import query

#: regions with divisions, nations below them; nations of every seventh key are deleted
_HAVE = """have AS (SELECT 'r' || r_regionkey AS path, true AS live FROM region UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey, n_nationkey % 7 <> 0 FROM nation),
new AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN 'No Slug' WHEN c_custkey % 13 = 0 THEN 'c' || (c_custkey // 100) ELSE 'c' || c_custkey END AS slug,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'r9/n' || c_nationkey WHEN c_custkey % 23 = 0 THEN 'r' || n_regionkey ELSE 'r' || n_regionkey || '/n' || c_nationkey END AS parent,
  CASE WHEN c_custkey % 34 = 0 THEN ['state', 'city'] WHEN c_custkey % 51 = 0 THEN ['state', ' '] WHEN c_custkey % 29 = 0 THEN ['x'] END AS divisions, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT *, CASE WHEN parent IS NULL THEN slug ELSE parent || '/' || slug END AS path FROM new),
j AS (SELECT p.*, CASE WHEN slug = 'No Slug' THEN 'slug form' WHEN parent IS NOT NULL AND parent NOT IN (SELECT path FROM have) THEN 'no such parent' WHEN parent IN (SELECT path FROM have WHERE NOT live) THEN 'parent is deleted'
  WHEN parent IS NULL AND divisions IS NULL THEN 'a country needs divisions' WHEN parent IS NOT NULL AND divisions IS NOT NULL THEN 'divisions are a country''s' WHEN divisions[2] = ' ' THEN 'blank division'
  WHEN min(seq) OVER (PARTITION BY path) < seq THEN 'path given twice' END AS fault FROM p)"""


def places(spark: SparkSession, d: str) -> DataFrame:
    r, n = tables(spark, d, "region", "nation")

    def name(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    nation = F.concat_ws("/", name("r", "n_regionkey"), name("n", "n_nationkey"))
    out = r.select(name("r", "r_regionkey").alias("location_path"), F.array(F.lit("state"), F.lit("city")).alias("divisions"), F.lit(None).cast("string").alias("status"))
    return out.unionByName(n.select(nation.alias("location_path"), F.lit(None).cast("array<string>").alias("divisions"), F.when(F.col("n_nationkey") % 7 == 0, "deleted").alias("status")))


def wanted(spark: SparkSession, d: str) -> DataFrame:
    c, n = tables(spark, d, "customer", "nation")
    k, region, nation = F.col("c_custkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    slug = F.when(k % 11 == 0, "No Slug").when(k % 13 == 0, F.concat(F.lit("c"), F.floor(k / 100).cast("string"))).otherwise(F.concat(F.lit("c"), k.cast("string")))
    parent = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.concat(F.lit("r9/"), nation)).when(k % 23 == 0, region).otherwise(F.concat_ws("/", region, nation))
    divisions = F.when(k % 34 == 0, F.array(F.lit("state"), F.lit("city"))).when(k % 51 == 0, F.array(F.lit("state"), F.lit(" "))).when(k % 29 == 0, F.array(F.lit("x")))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("seq"), slug.alias("slug"), F.col("c_name").alias("name"), parent.alias("parent"), divisions.alias("divisions"))


@query(f"WITH {_HAVE} SELECT seq, path AS location_path, CASE len(string_split(path, '/')) WHEN 1 THEN 'country' WHEN 2 THEN 'state' ELSE 'city' END AS type, array_to_string(divisions, ',') AS divisions FROM j WHERE fault IS NULL")
def places_made(spark, d):
    """Places to make, with the paths and types that follow from their parents."""
    good, _ = P.creations(wanted(spark, d), places(spark, d))
    return good.select("seq", "location_path", "type", F.array_join("divisions", ",").alias("divisions"))


@query(f"WITH {_HAVE} SELECT seq, fault FROM j WHERE fault IS NOT NULL")
def place_faults(spark, d):
    return P.creations(wanted(spark, d), places(spark, d))[1]


@query(
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 3 WHEN 0 THEN 'r' || (l_suppkey % 6) ELSE 'r' || n_regionkey || '/n' || n_nationkey END AS path, n_nationkey % 7 = 0 AND l_linenumber % 3 <> 0 AS gone,
  ['name', 'type', 'divisions', 'short_name'][1 + (l_partkey % 4)::INT] AS field, CASE WHEN l_quantity < 10 THEN '' WHEN l_quantity < 30 THEN '["a", "b"]' ELSE '["a", " "]' END AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT seq, fault, count(*) AS n FROM (SELECT seq, CASE WHEN path = 'r5' THEN 'no such place' WHEN gone THEN 'place is deleted' WHEN field = 'type' THEN 'type is fixed' WHEN field = 'divisions' AND contains(path, '/') THEN 'divisions are a country''s'
  WHEN field = 'divisions' AND value <> '["a", "b"]' THEN 'blank division' WHEN field = 'name' AND value = '' THEN 'no name' END AS fault FROM c) WHERE fault IS NOT NULL GROUP BY ALL"""
)
def place_patches(spark, d):
    """Changes of places that may not be made."""
    li, s, n = tables(spark, d, "lineitem", "supplier", "nation")
    rows = li.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    below = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    path = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("r"), (F.col("l_suppkey") % 6).cast("string"))).otherwise(below)
    field = F.get(F.array(*[F.lit(f) for f in ("name", "type", "divisions", "short_name")]), (F.col("l_partkey") % 4).cast("int"))
    value = F.when(F.col("l_quantity") < 10, "").when(F.col("l_quantity") < 30, '["a", "b"]').otherwise('["a", " "]')
    changes = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), path.alias("location_path"), field.alias("field"), value.alias("value"))
    return P.patch_faults(changes, places(spark, d)).groupBy("seq", "fault").agg(F.count(F.lit(1)).alias("n"))
