"""Cached payloads over the driver tables: one a customer, made from the customer and its orders; shipped returns are the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import payloads as P
from ..sources.readers import tables
from ._registry import query

NOW = "2001-08-01 12:00:00"
DAYS = 1000
#: a payload is as old as the customer's latest filled order; customers without one have none yet
_CACHE = """p AS (SELECT o_custkey AS id, max(o_orderdate) AS made_at, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
hit AS (SELECT o_custkey AS id, max(l_shipdate) AS seen FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R' GROUP BY 1),
s AS (SELECT p.*, CASE WHEN seen > made_at THEN 'changed' WHEN made_at <= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 1000 DAY THEN 'expired' END AS reason FROM p LEFT JOIN hit USING (id))"""


def now():
    return F.lit(NOW).cast(T.TimestampNTZType())


def payload_of(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_custkey").alias("payload_id")).agg(F.concat(F.lit('{"orders":'), F.count(F.lit(1)).cast("string"), F.lit("}")).alias("payload"))


def index_of(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_custkey").alias("payload_id"), F.lit("order").alias("entity_type"), F.col("o_orderkey").alias("entity_id"))


def cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o, li = tables(spark, d, "orders", "lineitem")
    filled = o.filter("o_orderstatus = 'F'")
    payloads = payload_of(filled).join(filled.groupBy(F.col("o_custkey").alias("payload_id")).agg(F.max("o_orderdate").alias("made_at")), "payload_id")
    changes = li.filter("l_returnflag = 'R'").select(F.lit("order").alias("entity_type"), F.col("l_orderkey").alias("entity_id"), F.col("l_shipdate").alias("at"))
    return payloads.withColumn("etag", F.md5("payload")).select(*P.COLUMNS), index_of(filled), changes


@query(f"WITH {_CACHE} SELECT id AS payload_id, reason FROM s WHERE reason IS NOT NULL")
def stale_payloads(spark, d):
    return P.stale(*cache(spark, d), now(), DAYS * 86_400)


@query(
    f"""WITH {_CACHE}, a AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
SELECT a.id AS payload_id, '{{"orders":' || CASE WHEN s.id IS NULL OR reason IS NOT NULL THEN a.n ELSE s.n END || '}}' AS payload, s.id IS NULL OR reason IS NOT NULL AS remade FROM a LEFT JOIN s USING (id)"""
)
def refreshed_payloads(spark, d):
    """Stale payloads and those that are not there yet are made from all orders; the others stay as they are."""
    payloads, parts, changes = cache(spark, d)
    o = tables(spark, d, "orders")[0]
    gone = P.stale(payloads, parts, changes, now(), DAYS * 86_400)

    def make(ids: DataFrame) -> P.Made:
        mine = o.join(ids.withColumnRenamed("payload_id", "o_custkey"), "o_custkey", "left_semi")
        return payload_of(mine), index_of(mine)

    after, _ = P.refreshed(payloads, parts, gone, o.select(F.col("o_custkey").alias("payload_id")).distinct(), make, now())
    return after.select("payload_id", "payload", (F.col("made_at") == now()).alias("remade"))
