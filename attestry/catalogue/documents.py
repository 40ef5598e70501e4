"""Served documents over the driver tables: orders as titles with their lines as models, suppliers as persons, parts' brands as makers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators._shared import parts_for, stored
from ..sources.readers import tables
from ._registry import query

#: one model a line number of an order; lines that come twice are one
_MODELS = """m AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey * 10 + l_linenumber AS model_id, l_orderkey AS title_id, l_returnflag AS flag, l_linestatus AS status, l_partkey AS part, l_suppkey AS supp, l_quantity::INT AS q,
  CASE WHEN l_quantity > 40 THEN (l_orderkey + l_partkey % 3 - 1) * 10 + 1 END AS converted, p_size AS size, p_type AS type, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey),
n AS (SELECT title_id, count(*) AS models, CASE WHEN count(flag) = count(*) AND min(flag) = max(flag) THEN min(flag) END AS flag, CASE WHEN min(status) = max(status) THEN min(status) END AS status FROM m GROUP BY 1)"""


def models(spark: SparkSession, d: str) -> DataFrame:
    li, p = tables(spark, d, "lineitem", "part")
    n = parts_for(li)
    one = li.repartition(n, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    rows = one.join(p.repartition(n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    converted = F.when(F.col("l_quantity") > 40, (F.col("l_orderkey") + F.col("l_partkey") % 3 - 1) * 10 + 1)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("model_id"), F.col("l_orderkey").alias("title_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("int").alias("q"), converted.alias("converted"), F.col("p_size").alias("size"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"),
    )


@query(
    f"""WITH {_MODELS}, tags AS (SELECT DISTINCT title_id, model_id, unnest(['s' || (size % 2), type]) AS v FROM m WHERE size > 5), t AS (SELECT title_id, string_agg(v, ',' ORDER BY v) AS tags FROM (SELECT title_id, v FROM tags JOIN n USING (title_id) GROUP BY title_id, v, models HAVING count(*) = models) GROUP BY 1),
f AS (SELECT title_id, string_agg(v || coalesce(':' || c, ''), ',' ORDER BY v) AS features FROM (SELECT title_id, 'w' || (size % 2) AS v, CASE WHEN min(q % 2) = max(q % 2) THEN min(q % 2) END AS c FROM m JOIN n USING (title_id) GROUP BY title_id, 2, models HAVING count(*) = models) GROUP BY 1),
i AS (SELECT title_id, min(s) AS themes FROM (SELECT title_id, model_id, CASE WHEN supp % 4 < 2 THEN 'a' ELSE 'a,b' END AS s FROM m) GROUP BY 1 HAVING min(s) = max(s)),
c AS (SELECT title_id, string_agg(p || '/' || r, ',' ORDER BY p, r) AS credits FROM (SELECT title_id, supp % 3 AS p, m.flag AS r FROM m JOIN n USING (title_id) GROUP BY title_id, 2, 3, models HAVING count(*) = models) GROUP BY 1),
l AS (SELECT a.title_id, string_agg(b.title_id || '<' || a.model_id, ',' ORDER BY b.title_id, a.model_id) AS related FROM m a JOIN m b ON b.model_id = a.converted WHERE a.title_id <> b.title_id GROUP BY 1),
e AS (SELECT title_id, count(DISTINCT part) AS media FROM m GROUP BY 1)
SELECT title_id, models, n.flag, n.status, coalesce(tags, '') AS tags, coalesce(features, '') AS features, coalesce(themes, '') AS themes, coalesce(credits, '') AS credits, coalesce(related, '') AS related, coalesce(media, 0) AS media
FROM n LEFT JOIN t USING (title_id) LEFT JOIN f USING (title_id) LEFT JOIN i USING (title_id) LEFT JOIN c USING (title_id) LEFT JOIN l USING (title_id) LEFT JOIN e USING (title_id)"""
)
def title_documents(spark, d):
    """Every title with what all of its models agree on and share, its links to other titles and its media."""
    m = stored(models(spark, d), "models")  # every part of a document reads them
    tags = m.filter("size > 5").select("model_id", F.explode(F.array(F.concat(F.lit("s"), (F.col("size") % 2).cast("string")), F.col("type"))).alias("value"))
    features = m.select("model_id", F.concat(F.lit("w"), (F.col("size") % 2).cast("string")).alias("value"), (F.col("q") % 2).alias("count"))
    themes = m.select("model_id", F.explode(F.when(F.col("supp") % 4 < 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("a")))).alias("value"))
    credits = m.select("model_id", (F.col("supp") % 3).alias("person"), F.col("flag").alias("role"))
    out = D.title_documents(m, ["flag", "status"], {"tags": tags}, {"features": features}, {"themes": themes}, credits, {"converted from": "converted"}, m.select("model_id", F.col("part").alias("asset_id")), parts=parts_for(m))

    def text(column, item):
        return F.array_join(F.transform(column, item), ",").alias(column)

    return out.select(
        "title_id", "models", "flag", "status", F.array_join("tags", ",").alias("tags"), text("features", lambda x: F.concat(x["value"], F.coalesce(F.concat(F.lit(":"), x["count"].cast("string")), F.lit("")))), F.array_join("themes", ",").alias("themes"),
        text("credits", lambda x: F.concat_ws("/", x["person"].cast("string"), x["role"])), text("related", lambda x: F.concat_ws("<", x["title_id"].cast("string"), x["model_id"].cast("string"))), F.size("media").cast("bigint").alias("media"),
    )


@query(
    """WITH c AS (SELECT l_suppkey AS k, l_orderkey AS m FROM lineitem WHERE l_quantity > 30), o AS (SELECT o_orderkey AS m, CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END AS y, CASE WHEN o_orderstatus <> 'P' THEN 'i' || o_orderkey END AS image FROM orders),
t AS (SELECT k, arg_min(image, (CASE WHEN y IS NULL THEN 1 ELSE 0 END, coalesce(-y, 0), m)) AS thumbnail FROM (SELECT DISTINCT k, m FROM c) JOIN o USING (m) WHERE image IS NOT NULL GROUP BY 1)
SELECT s_suppkey AS entity_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'A' || s_nationkey || ',' || lower(s_name) ELSE '' END AS aliases, (SELECT count(*) FROM c WHERE k = s_suppkey) AS credit_count, thumbnail FROM supplier LEFT JOIN t ON k = s_suppkey WHERE s_suppkey % 9 <> 0"""
)
def person_documents(spark, d):
    """Every active person with aliases, credits and the image of the newest game with one."""
    s, li, o = tables(spark, d, "supplier", "lineitem", "orders")
    k = F.col("s_suppkey")
    people = s.select(k.alias("entity_id"), F.col("s_name").alias("name"), F.lower("s_name").alias("slug"), F.when(k % 9 == 0, "deleted").alias("status"))
    aliases = s.filter("s_suppkey % 2 = 0").select(k.alias("entity_id"), F.explode(F.array(F.lower("s_name"), F.concat(F.lit("A"), F.col("s_nationkey").cast("string")), F.lower("s_name"))).alias("value"))
    credits = li.filter("l_quantity > 30").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("model_id"))
    games = o.select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")).alias("year"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("i"), F.col("o_orderkey").cast("string"))).alias("image"))
    out = D.person_documents(people, aliases, credits, games)
    return out.select("entity_id", "name", F.array_join("aliases", ",").alias("aliases"), "credit_count", "thumbnail")


@query(
    """WITH b AS (SELECT DISTINCT p_brand AS name, substr(p_brand, 7)::INT AS e FROM part), k AS (SELECT s_suppkey AS c, 1 + s_suppkey % 25 AS e, s_nationkey FROM supplier),
m AS (SELECT o_orderkey AS id, (o_custkey % (SELECT count(*) FROM supplier)) AS c, o_orderpriority AS name, year(o_orderdate) AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'i' || o_orderkey END AS image FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0),
x AS (SELECT e, m.* FROM m JOIN k USING (c)), t AS (SELECT e, arg_min(image, (-y, name, id)) AS thumbnail FROM x WHERE image IS NOT NULL GROUP BY 1),
p AS (SELECT e, string_agg(v, ',' ORDER BY v) AS places FROM (SELECT DISTINCT e, unnest([r_name, r_name || '/' || n_name]) AS v FROM k JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey) GROUP BY 1)
SELECT b.e AS entity_id, b.name, (SELECT count(*) FROM x WHERE x.e = b.e) AS model_count, (SELECT min(y) FROM x WHERE x.e = b.e) AS year_min, (SELECT max(y) FROM x WHERE x.e = b.e) AS year_max, thumbnail, coalesce(places, '') AS places,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN x ON x.id = l_orderkey WHERE x.e = b.e) AS persons FROM b LEFT JOIN t USING (e) LEFT JOIN p USING (e)"""
)
def maker_pages(spark, d):
    """Every maker with what its companies made, where they are, and how many persons are credited."""
    p, s, o, n, r, li = tables(spark, d, "part", "supplier", "orders", "nation", "region", "lineitem")
    makers = p.select(F.substring("p_brand", 7, 9).cast("int").alias("entity_id"), F.col("p_brand").alias("name"), F.lower("p_brand").alias("slug"), F.lit("active").alias("status")).distinct()
    companies = s.select(F.col("s_suppkey").alias("company_id"), (F.col("s_suppkey") % 25 + 1).cast("int").alias("entity_id"))
    many = s.select(F.count(F.lit(1))).scalar()
    games = o.select(
        F.col("o_orderkey").alias("model_id"), (F.col("o_custkey") % many).alias("company_id"), F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("i"), F.col("o_orderkey").cast("string"))).alias("image"),
        F.when(F.col("o_orderstatus") == "P", "deleted").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 1).alias("variant_of"),
    )
    places = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("company_id"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    out = D.maker_documents(makers, companies, games, places, li.select(F.col("l_orderkey").alias("model_id"), F.col("l_suppkey").cast("string").alias("person")))
    return out.select("entity_id", "name", "model_count", "year_min", "year_max", "thumbnail", F.array_join("places", ",").alias("places"), F.size("persons").cast("bigint").alias("persons"))
