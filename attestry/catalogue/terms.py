"""Feature lines, vocabularies, links in texts and citations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import narratives as N
from ..operators import vocabulary as V
from ..operators._shared import parts_for
from ..sources.readers import table, tables
from ._registry import query


@query(
    """SELECT p_partkey, 0 AS place, p_name AS name, CAST(p_size AS INT) AS count FROM part UNION ALL SELECT p_partkey, 1, p_brand || ' (left, right)', NULL FROM part
UNION ALL SELECT p_partkey, 2, p_type, NULL FROM part"""
)
def feature_lines(spark, d):
    """Lines such as ``small bolt (4), Brand#1 (left, right). PROMO,`` of every part."""
    p = table(spark, d, "part")
    line = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit("), "), "p_brand", F.lit(" (left, right). "), "p_type", F.lit(","))
    return p.select("p_partkey", F.posexplode(V.feature_parts(line)).alias("place", "x")).select("p_partkey", "place", "x.name", "x.count")


_TERMS = """t AS (SELECT p_partkey, 0 AS place, p_type AS term FROM part UNION ALL SELECT p_partkey, 1, upper(p_name) FROM part UNION ALL SELECT p_partkey, 2, p_name FROM part UNION ALL SELECT p_partkey, 3, p_brand FROM part
  UNION ALL SELECT p_partkey, 4, 'Brand#1' FROM part),
s AS (SELECT p_partkey, place, term, CASE WHEN term LIKE 'E%' AND place = 0 THEN 'reward' WHEN place = 0 OR term ILIKE '%widget' THEN 'feature' WHEN place > 2 AND term LIKE 'Brand#1%' THEN 'cabinet' END AS kind FROM t),
k AS (SELECT *, CASE WHEN kind IS NOT NULL THEN lower(term) END AS slug FROM s WHERE kind IS NOT NULL OR term <> 'Brand#2'),
u AS (SELECT * FROM k WHERE kind IS NULL UNION ALL SELECT * FROM k WHERE kind IN ('reward', 'feature') QUALIFY row_number() OVER (PARTITION BY p_partkey, kind, slug ORDER BY place) = 1
  UNION ALL SELECT * FROM k WHERE kind = 'cabinet' QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY place DESC) = 1)"""


def _sorted(spark, d):
    p = table(spark, d, "part")
    word = lambda c: p.select(F.col(c).alias("term"), F.lower(c).alias("slug")).distinct()
    known = {"reward": word("p_type").filter("term LIKE 'E%'"), "feature": word("p_type").unionByName(word("p_name").filter("term LIKE '%widget'")), "cabinet": word("p_brand").filter("term LIKE 'Brand#1%'")}
    rows = p.select("p_partkey", F.array("p_type", F.upper("p_name"), "p_name", "p_brand", F.lit("Brand#1")).alias("terms"))
    return V.sorted_terms(rows, "p_partkey", "terms", known, single=("cabinet",), ignored=("Brand#2",), parts=parts_for(p, each=5))


@query(f"WITH {_TERMS} SELECT * FROM u")
def sorted_terms(spark, d):
    """The terms of every part by vocabulary: types that are rewards before types and names that are features; one cabinet, the last."""
    return _sorted(spark, d)


@query(f"WITH {_TERMS} SELECT p_partkey, kind || '|' || kind || ':' || slug AS claim_key FROM u WHERE kind IN ('reward', 'feature')")
def vocabulary_claims(spark, d):
    """Claims of features and rewards that a vocabulary knows; unknown terms never make a new one."""
    known = _sorted(spark, d).filter(F.col("kind").isin("reward", "feature"))
    return known.select("p_partkey", F.concat("kind", F.lit("|"), "kind", F.lit(":"), "slug").alias("claim_key"))


@query(
    """WITH l AS (SELECT c_custkey, trim(regexp_replace(replace(replace(c_name || ' of  [nation ' || c_nationkey || '] and more', '[', ''), ']', ''), '\\s+', ' ', 'g')) AS label FROM customer WHERE c_custkey % 5 <> 0)
SELECT o_orderkey, 'By ' || CASE WHEN c_custkey IS NULL THEN '[broken link]' ELSE '[' || CASE WHEN length(label) > 30 THEN left(label, 30) || '...' ELSE label END || '](/people/' || c_custkey || ')' END
  || ', see [1] and ' || CASE WHEN o_orderkey = 7 THEN '[1]' WHEN EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = 7) THEN '[2]' ELSE '[broken link]' END || ', again [1].' AS text, 4 AS n_links
FROM orders LEFT JOIN l ON o_custkey = c_custkey"""
)
def rendered_links(spark, d):
    """Notes of every order with links to its customer (one in five leads nowhere) and numbered citations, one of them twice."""
    o, c = tables(spark, d, "orders", "customer")
    id_ = F.col("o_orderkey").cast("string")
    notes = o.select("o_orderkey", F.concat(F.lit("By [[person:"), F.col("o_custkey").cast("string"), F.lit("]], see [[cite:"), id_, F.lit("]] and [[cite:7]], again [[cite:"), id_, F.lit("]].")).alias("text"))
    ref = F.col("c_custkey").cast("string")
    people = c.filter("c_custkey % 5 <> 0").select(
        F.lit("person").alias("type"), ref.alias("ref"), F.concat("c_name", F.lit(" of  [nation "), F.col("c_nationkey").cast("string"), F.lit("] and more")).alias("label"), F.concat(F.lit("/people/"), ref).alias("url")
    )
    cites = o.select(F.lit("cite").alias("type"), id_.alias("ref"), F.lit("").alias("label"), F.lit("").alias("url"))
    return V.rendered_links(notes, "o_orderkey", "text", people.unionByName(cites), numbered=("cite",))


@query("SELECT event_id, citation_source_id, locator FROM events, (VALUES (4, 'p. 12'), (9, '')) w(citation_source_id, locator)")
def attached_citations(spark, d):
    return V.with_citations(table(spark, d, "events").select("event_id"), [(4, "p. 12"), (9, "")])


NOTICES = [N.Rule("license", "license"), N.Rule("mit license", "mit"), N.Rule("apache license", "apache"), N.Rule("public license", "public"), N.Rule("general public license", "gpl")]


@query(
    r"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(t, '\bmit license\b')) AS mit, len(regexp_extract_all(t, '\bapache license\b')) AS apache, len(regexp_extract_all(t, '\bgeneral public license\b')) AS gpl,
  len(regexp_extract_all(t, '\bpublic license\b')) AS public, len(regexp_extract_all(t, '\blicense\b')) AS every FROM t),
u AS (SELECT doc_id, 'mit' AS slug, mit AS n FROM n UNION ALL SELECT doc_id, 'apache', apache FROM n UNION ALL SELECT doc_id, 'gpl', gpl FROM n UNION ALL SELECT doc_id, 'public', public - gpl FROM n UNION ALL SELECT doc_id, 'license', every - mit - apache - public FROM n)
SELECT doc_id, slug, n FROM u WHERE n > 0 AND NOT (slug = 'license' AND EXISTS (SELECT 1 FROM u v WHERE v.doc_id = u.doc_id AND v.slug <> 'license' AND v.n > 0)) AND NOT (slug = 'public' AND EXISTS (SELECT 1 FROM u v WHERE v.doc_id = u.doc_id AND v.slug = 'gpl' AND v.n > 0))"""
)
def narrative_rules(spark, d):
    """Licences that whole texts name: the special name wins where names overlap, and general ones give way where a special one is named."""
    slugs = spark.createDataFrame([(r.slug,) for r in NOTICES], "slug string")
    parents = spark.createDataFrame([(s, "license") for s in ("mit", "apache", "public", "gpl")] + [("gpl", "public")], "slug string, parent string")
    return N.features(table(spark, d, "documents"), "doc_id", "text", NOTICES, slugs, parents).select("doc_id", "slug", "n")
