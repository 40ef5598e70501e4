"""Incremental maintenance over the driver tables: regions and nations are places, customers live in nations, some nations move and change their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators._shared import stored
from ..operators.resolve import winners
from ..plans.specs import EntitySpec, FieldSpec
from ..sources.readers import tables
from ._registry import query

PLACE = EntitySpec("place", (FieldSpec("slug"), FieldSpec("name"), FieldSpec("parent", target="place")))
CUSTOMER = EntitySpec("customer", (FieldSpec("name"), FieldSpec("home", target="place")))
DERIVED = [M.Copy("customer", "home_name", "home", "name"), M.Rollup("place", "customers", "parent", "customer", "home")]


def claims(rows: DataFrame, kind: str, id_, at: int, **fields) -> DataFrame:
    said = rows.select(id_.cast("bigint").alias("entity_id"), *[c.cast("string").alias(n) for n, c in fields.items()]).unpivot("entity_id", list(fields), "field_name", "value")
    return said.select(F.lit(kind).alias("entity_type"), "entity_id", "field_name", F.col("field_name").alias("claim_key"), "value", F.lit(at).alias("created_at"), F.lit(0).alias("priority"), F.lit(at).alias("claim_id"))


def maintained(spark: SparkSession, d: str) -> dict[str, M.Changing]:
    """Places: regions by their key, nations by 1000 and more. Nations of every third key go to the next region, those of every fourth change their name, customers of
    every tenth key go to the next nation: as claims that come later."""
    r, n, c = tables(spark, d, "region", "nation", "customer")

    def slug(prefix, column):
        return F.concat(F.lit(prefix), column.cast("string"))

    nation = F.col("n_nationkey")
    first = claims(r, "place", F.col("r_regionkey"), 1, slug=slug("r", F.col("r_regionkey")), name=F.col("r_name"))
    first = first.unionByName(claims(n, "place", nation + 1000, 1, slug=slug("n", nation), name=F.col("n_name"), parent=slug("r", F.col("n_regionkey"))))
    first = first.unionByName(claims(c, "customer", F.col("c_custkey"), 1, name=F.col("c_name"), home=slug("n", F.col("c_nationkey"))))
    later = claims(n.filter("n_nationkey % 3 = 0"), "place", nation + 1000, 2, parent=slug("r", (F.col("n_regionkey") + 1) % 5))
    later = later.unionByName(claims(n.filter("n_nationkey % 4 = 0"), "place", nation + 1000, 2, name=F.concat(F.lit("New "), F.col("n_name"))))
    later = later.unionByName(claims(c.filter("c_custkey % 10 = 0"), "customer", F.col("c_custkey"), 2, home=slug("n", (F.col("c_nationkey") + 1) % 25)))
    ids = {"place": first.filter("entity_type = 'place'").select("entity_id").distinct(), "customer": c.select(F.col("c_custkey").cast("bigint").alias("entity_id"))}
    # what was materialized is a table, and winners are picked once, however many steps read them
    before = {n: stored(t, "before") for n, t in M.materialized(stored(winners(first), "won"), [CUSTOMER, PLACE], DERIVED, ids).items()}
    return M.maintained(stored(winners(first.unionByName(later)), "won"), [CUSTOMER, PLACE], DERIVED, later, before)


_NOW = """n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'New ' || n_name ELSE n_name END AS name, CASE WHEN n_nationkey % 3 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END AS region FROM nation),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS k FROM customer)"""


@query(f"WITH {_NOW} SELECT c_custkey AS entity_id, name AS home_name, k::BIGINT + 1000 AS home_id FROM c LEFT JOIN n USING (k)")
def maintained_copies(spark, d):
    return maintained(spark, d)["customer"].now().select("entity_id", "home_name", "home_id")


@query(
    f"""WITH {_NOW} SELECT n.k::BIGINT + 1000 AS entity_id, name, count(c_custkey) AS customers FROM n LEFT JOIN c USING (k) GROUP BY ALL
UNION ALL SELECT r_regionkey, r_name, count(c_custkey) FROM region LEFT JOIN n ON region = r_regionkey LEFT JOIN c USING (k) GROUP BY ALL"""
)
def maintained_rollups(spark, d):
    return maintained(spark, d)["place"].now().select("entity_id", "name", "customers")


@query(
    f"""WITH {_NOW} SELECT 'customer' AS entity, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 10 = 0 OR n_nationkey % 4 = 0
UNION ALL SELECT 'place', count(DISTINCT e) FROM (SELECT 1000 + n_nationkey AS e FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 4 = 0
  UNION SELECT r FROM (SELECT n_regionkey AS r FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT (n_regionkey + 1) % 5 FROM nation WHERE n_nationkey % 3 = 0)
  UNION SELECT 1000 + c_nationkey FROM customer WHERE c_custkey % 10 = 0 UNION SELECT 1000 + (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 10 = 0
  UNION SELECT region FROM n WHERE k IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 0 UNION SELECT (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 10 = 0)
  UNION SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 0 UNION SELECT (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 10 = 0))"""
)
def maintained_reach(spark, d):
    """How many rows were computed anew: the touched ones and those that the dependencies reach, no others."""
    after = maintained(spark, d)
    rows = [after[n].rows.select(F.lit(n).alias("entity")) for n in ("customer", "place")]
    return rows[0].unionByName(rows[1]).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
