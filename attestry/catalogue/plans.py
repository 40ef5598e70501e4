"""Plans whose entities and claims name one another: regions, nations and customers as three generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generations as G
from ..plans.specs import RelationshipSpec
from ..sources.readers import tables
from ._registry import query

LIVES = RelationshipSpec("lives", ("customer",), {"nation": "int", "region": "int", "segment": "string"})
#: two regions are there already; new ids begin at 10,000, by generation and key
_MADE = """ex(entity_key, id) AS (SELECT 'region|name:' || r_name, 100 + r_regionkey FROM region WHERE r_regionkey < 2),
r AS (SELECT r_regionkey AS k, 'region|name:' || r_name AS key, coalesce(id, 9999 + row_number() OVER (PARTITION BY id IS NULL ORDER BY r_regionkey)) AS id, id IS NULL AS is_new FROM region LEFT JOIN ex ON entity_key = 'region|name:' || r_name),
n AS (SELECT n_nationkey AS k, n_regionkey AS up, 'nation|name:' || n_name || '|region:' || r.id AS key, 9999 + (SELECT count(*) FROM r WHERE is_new) + row_number() OVER (ORDER BY n_nationkey) AS id FROM nation JOIN r ON r.k = n_regionkey),
c AS (SELECT c_custkey AS k, c_nationkey AS up, c_mktsegment AS segment, 'customer|name:' || c_name || '|nation:' || n.id AS key, 9999 + (SELECT count(*) FROM r WHERE is_new) + (SELECT count(*) FROM n) + row_number() OVER (ORDER BY c_custkey) AS id FROM customer JOIN n ON n.k = c_nationkey)"""


def plan(spark, d):
    r, n, c = tables(spark, d, "region", "nation", "customer")

    def handle(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def rows(df, kind, key, name, refs):
        parts = F.create_map(*[x for k, v in refs.items() for x in (F.lit(k), v)]) if refs else F.expr("cast(map() AS map<string,string>)")
        return df.select(handle(kind[0], key).alias("handle"), F.col(key).cast("bigint").alias("seq"), F.lit(kind).alias("entity_type"), F.create_map(F.lit("name"), F.col(name)).alias("identity"), parts.alias("refs"))

    # customers come first in the plan: its order is not that of the generations
    out = rows(c, "customer", "c_custkey", "c_name", {"nation": handle("n", "c_nationkey")}).unionByName(rows(r, "region", "r_regionkey", "r_name", {}))
    return out.unionByName(rows(n, "nation", "n_nationkey", "n_name", {"region": handle("r", "n_regionkey")}))


def made(spark, d):
    r = tables(spark, d, "region")[0]
    there = r.filter("r_regionkey < 2").select(F.concat(F.lit("region|name:"), "r_name").alias("entity_key"), (F.col("r_regionkey") + 100).cast("bigint").alias("entity_id"))
    return G.with_ids(plan(spark, d), there, 10_000)[0]


@query(
    f"""WITH {_MADE} SELECT 'r' || k AS handle, id::BIGINT AS entity_id, key AS entity_key, 0 AS generation, is_new FROM r UNION ALL SELECT 'n' || k, id, key, 1, true FROM n UNION ALL SELECT 'c' || k, id, key, 2, true FROM c"""
)
def planned_generations(spark, d):
    return made(spark, d).select("handle", "entity_id", "entity_key", "generation", "is_new")


@query(
    f"""WITH {_MADE} SELECT c.id::BIGINT AS entity_id, 'lives|nation:' || n.id || '|region:' || r.id || '|segment:' || segment AS claim_key,
  '{{"exists":true,"nation":' || n.id || ',"region":' || r.id || ',"segment":"' || segment || '"}}' AS value FROM c JOIN n ON n.k = c.up JOIN r ON r.k = n.up"""
)
def planned_references(spark, d):
    """Claims of planned customers, whose keys and values hold the ids of a planned nation and region."""
    c, n = tables(spark, d, "customer", "nation")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    said = rows.select(
        F.col("c_custkey").alias("seq"), F.lit(None).cast("bigint").alias("entity_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("handle"), F.lit("lives").alias("field_name"), F.lit(None).cast("string").alias("value"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("identity"),
        F.create_map(F.lit("nation"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit("region"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("refs"),
    )
    claims, _ = G.with_references(said, made(spark, d), [LIVES])
    return claims.select("entity_id", "claim_key", "value")
