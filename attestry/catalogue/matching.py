"""Cascades, unique keys, near duplicates, dictionaries, slugs and places over parts, documents and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import matching as M
from ..sources.readers import table, tables
from ._registry import query


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_brand || ':' || p_size AS code FROM part WHERE p_partkey % 2 = 0), r AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey, p_name, p_brand || ':' || p_size AS code FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50),
m AS (SELECT r.*, (SELECT min(p_partkey) FROM t WHERE t.p_partkey = r.l_partkey) AS a, (SELECT min(p_partkey) FROM t WHERE t.code = r.code) AS b, (SELECT min(p_partkey) FROM t WHERE t.p_name = r.p_name) AS c FROM r)
SELECT k, ln, l_partkey, coalesce(a, b, c) AS target, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'code' WHEN c IS NOT NULL THEN 'name' END AS match_type FROM m"""
)
def cascade_match(spark, d):
    """Only lines of quantity 50; :func:`cascade_match_all` takes every line."""
    return _cascade(spark, d, "l_quantity = 50")


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_brand || ':' || p_size AS code FROM part WHERE p_partkey % 2 = 0), tc AS (SELECT code, min(p_partkey) AS b FROM t GROUP BY 1), tn AS (SELECT p_name, min(p_partkey) AS c FROM t GROUP BY 1),
m AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey, t.p_partkey AS a, b, c FROM lineitem JOIN part p ON l_partkey = p.p_partkey LEFT JOIN t ON t.p_partkey = l_partkey LEFT JOIN tc ON tc.code = p.p_brand || ':' || p.p_size LEFT JOIN tn ON tn.p_name = p.p_name)
SELECT k, ln, l_partkey, coalesce(a, b, c) AS target, CASE WHEN a IS NOT NULL THEN 'id' WHEN b IS NOT NULL THEN 'code' WHEN c IS NOT NULL THEN 'name' END AS match_type FROM m"""
)
def cascade_match_all(spark, d):
    return _cascade(spark, d, "true")


def _cascade(spark, d, lines):
    li, p = tables(spark, d, "lineitem", "part")
    code = F.concat_ws(":", "p_brand", F.col("p_size").cast("string"))
    rows = li.filter(lines).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), "l_partkey", "p_name", code.alias("code"))
    targets = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("t_name"), code.alias("t_code"))
    keys = [("id", F.col("l_partkey"), F.col("target")), ("code", F.col("code"), F.col("t_code")), ("name", F.col("p_name"), F.col("t_name"))]
    return M.cascade(rows, targets, keys, "target").select("k", "ln", "l_partkey", "target", "match_type")


@query("SELECT lower(p_name) || ':' || p_size AS key, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1")
def fuzzy_unique_key(spark, d):
    p = table(spark, d, "part")
    return M.unique_keys(p, F.concat_ws(":", N.without_suffixes(F.col("p_name")), F.col("p_size").cast("string")), "p_partkey")


@query("SELECT p_name || ':' || p_size AS key, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def agreeing_key(spark, d):
    return M.unique_keys(table(spark, d, "part"), F.concat_ws(":", "p_name", F.col("p_size").cast("string")), "p_brand", by_row=False)


@query("WITH x AS (SELECT DISTINCT p_partkey AS p, string_split(p_name, ' ')[-1] AS l, l_orderkey AS o FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 40) SELECT DISTINCT a.p AS left_id, b.p AS right_id FROM x a JOIN x b ON a.o = b.o AND a.l = b.l AND a.p < b.p")
def near_duplicate_pairs(spark, d):
    """Only lines of quantity 40 and more; :func:`near_duplicate_pairs_all` takes every line."""
    return _near_duplicates(spark, d, "l_quantity >= 40")


@query("WITH x AS (SELECT DISTINCT p_partkey AS p, string_split(p_name, ' ')[-1] AS l, l_orderkey AS o FROM part JOIN lineitem ON l_partkey = p_partkey) SELECT DISTINCT a.p AS left_id, b.p AS right_id FROM x a JOIN x b ON a.o = b.o AND a.l = b.l AND a.p < b.p")
def near_duplicate_pairs_all(spark, d):
    return _near_duplicates(spark, d, "true")


def _near_duplicates(spark, d, lines):
    p, li = tables(spark, d, "part", "lineitem")
    works = li.filter(lines).select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return M.near_duplicates(p, works, "p_partkey", F.col("p_name"), "l_orderkey")


TERMS = ["mit license", "the", "und", "pour la", "que", "apache license", "of the"]


@query(
    "WITH v(term) AS (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + r"""), w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS t FROM documents)
SELECT doc_id, term FROM w JOIN v ON contains(t, ' ' || term || ' ')"""
)
def dictionary_match(spark, d):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return M.dictionary_matches(table(spark, d, "documents").select("doc_id", "text"), "text", terms, "term").select("doc_id", "term")


@query("SELECT DISTINCT ON (p_name) p_name AS key, p_partkey FROM part ORDER BY p_name, p_partkey")
def alias_first(spark, d):
    p = table(spark, d, "part").withColumn("seq", F.col("p_partkey"))
    return M.aliases(p, F.col("p_name"), "p_partkey", "first")


@query("SELECT p_name AS key, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def alias_skip(spark, d):
    p = table(spark, d, "part").withColumn("seq", F.col("p_partkey"))
    return M.aliases(p, F.col("p_name"), "p_brand", "skip")


@query("SELECT p_name || ' ' || p_size AS key, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def alias_skip_ambiguous(spark, d):
    """As :func:`alias_skip`, with keys of which some lead to one value and some to several."""
    p = table(spark, d, "part").withColumn("seq", F.col("p_partkey"))
    return M.aliases(p, F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), "p_brand", "skip")


@query(
    """WITH t AS (SELECT DISTINCT replace(p_name, ' ', '-') AS b FROM part), used AS (SELECT b, 1 AS n FROM t WHERE length(b) % 2 = 0 UNION ALL SELECT b, 3 FROM t WHERE length(b) % 3 = 0),
r AS (SELECT p_partkey, replace(p_name, ' ', '-') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part),
f AS (SELECT p_partkey, b, CASE WHEN length(b) % 2 = 0 THEN r + 1 ELSE r END AS n FROM r), g AS (SELECT p_partkey, b, CASE WHEN length(b) % 3 = 0 AND n >= 3 THEN n + 1 ELSE n END AS n FROM f)
SELECT p_partkey, CASE WHEN n = 1 THEN b ELSE b || '-' || n END AS slug FROM g"""
)
def unique_slugs(spark, d):
    p = table(spark, d, "part").select("p_partkey", N.slug(F.col("p_name")).alias("base"))
    b = p.select("base").distinct()
    taken = b.filter("length(base) % 2 = 0").select(F.col("base").alias("slug")).unionByName(b.filter("length(base) % 3 = 0").select(F.concat("base", F.lit("-3")).alias("slug")))
    return M.unique_slugs(p, "base", "p_partkey", taken).select("p_partkey", "slug")


@query(
    """WITH x AS (SELECT s_suppkey, r_name AS country, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, CASE WHEN city = '' THEN lower(country) ELSE lower(country) || '/' || lower(city) END AS location_path FROM x"""
)
def place_lookup(spark, d):
    s, n, r = tables(spark, d, "supplier", "nation", "region")
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    places = r.select(F.lower("r_name").alias("location_path"), F.col("r_name").alias("name")).unionByName(named.select(F.lower(F.concat_ws("/", "r_name", "n_name")).alias("location_path"), F.col("n_name").alias("name")))
    rows = s.join(named, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("country"), F.lit("").alias("state"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("city"))
    return M.place_of(rows, places, "city", "state", "country").select("s_suppkey", "location_path")
