"""Rules of claims, plans, writes and displays over whole driver tables, one query a rule."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import names as N
from ..functions import values as V
from ..operators import claims as C
from ..operators import hierarchy as Y
from ..operators import history as H
from ..operators import lifecycle as Z
from ..operators import resolve as R
from ..operators._shared import parts_for, stored
from ..plans.specs import EntitySpec, FieldSpec, RelationshipSpec
from ..sources import sinks as S
from ..sources.readers import table, tables
from ._registry import query
from .claims import CLAIMS_SQL, EFFECTIVE_SQL, effective, event_claims, sources
from .serving import supplier_paths

# --- claims


_KINDS = EntitySpec("user", (FieldSpec("click", "int", least=10, most=60), FieldSpec("view", choices=("1", "2", "3", "4", "5")), FieldSpec("purchase", "boolean")), extra=True)
_GUEST = EntitySpec("guest", (FieldSpec("click", "int"),))
_ERROR = RelationshipSpec("error", ("guest",), {"code": "int"})


@query(
    f"""WITH {CLAIMS_SQL}, c AS (SELECT *, entity_id % 10 = 0 AS guest FROM claims)
SELECT claim_id, CASE WHEN guest THEN CASE field_name WHEN 'click' THEN 'direct' WHEN 'error' THEN 'relationship' ELSE 'unrecognized' END WHEN field_name IN ('click', 'view', 'purchase') THEN 'direct' ELSE 'extra' END AS claim_class,
  CASE WHEN guest THEN CASE field_name WHEN 'click' THEN NULL WHEN 'error' THEN 'not an object' ELSE 'unrecognized field' END
  WHEN field_name = 'click' AND value::INT < 10 THEN 'below minimum' WHEN field_name = 'click' AND value::INT > 60 THEN 'above maximum' WHEN field_name = 'view' AND value NOT IN ('1', '2', '3', '4', '5') THEN 'choice' END AS reject_reason FROM c"""
)
def claim_validation(spark, d):
    """Class of every claim and why it is refused, if it is: bounds, choices, what an entity doesn't know, relationships that are no object."""
    guest = F.col("entity_id") % 10 == 0
    rows = event_claims(spark, d).withColumn("entity_type", F.when(guest, "guest").otherwise("user"))
    return C.validated(rows, [_KINDS, _GUEST], [_ERROR]).select("claim_id", "claim_class", "reject_reason")


_SUPPLY = RelationshipSpec("supply", ("part",), {"supplier": "int"}, {"quantity": "int"})


@query(
    """SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'subject' WHEN 2 THEN 'not an object' WHEN 3 THEN 'exists' WHEN 4 THEN 'missing supplier' WHEN 5 THEN 'type of supplier' WHEN 6 THEN 'unknown key' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'key' END END AS fault, count(*) AS n
FROM lineitem GROUP BY ALL"""
)
def relationship_faults(spark, d):
    """The first rule that a relationship claim breaks; lines break one each by their number, and half of the seventh none."""
    li, n, s = table(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    whole = F.concat(F.lit('{"exists":true,"quantity":1,"supplier":'), s, F.lit("}"))
    value = F.when(n == 2, "[1]").when(n == 3, F.concat(F.lit('{"exists":1,"supplier":'), s, F.lit("}"))).when(n == 4, '{"exists":true}').when(n == 5, F.concat(F.lit('{"exists":true,"supplier":"'), s, F.lit('"}')))
    value = value.when(n == 6, F.concat(F.lit('{"exists":false,"colour":1,"supplier":'), s, F.lit("}"))).otherwise(whole)
    key = F.when((n == 7) & (F.col("l_suppkey") % 2 == 0), "supply|supplier:x").otherwise(F.concat(F.lit("supply|supplier:"), s))
    rows = li.select("l_linenumber", F.when(n == 1, "order").otherwise("part").alias("entity_type"), value.alias("value"), key.alias("claim_key"))
    return rows.withColumn("fault", C.relationship_fault(_SUPPLY)).groupBy("l_linenumber", "fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 10 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def missing_targets(spark, d):
    """Claims whose part is not among those there are; claims of absence need none."""
    li, p = tables(spark, d, "lineitem", "part")
    value = F.to_json(F.struct((F.col("l_quantity") >= 10).alias("exists"), F.col("l_partkey").alias("part")))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("value"))
    return C.missing_targets(rows, F.get_json_object("value", "$.part").cast("bigint"), p.filter("p_size > 5"), "p_partkey").drop("value")


@query(
    """WITH e AS (SELECT 'r' || r_regionkey AS handle, 100 + r_regionkey AS seq, []::VARCHAR[] AS refs FROM region UNION ALL SELECT 'n' || n_nationkey, 5 * n_nationkey, ['r' || n_regionkey] FROM nation UNION ALL SELECT 'n3', 999, []),
a AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN 'n' || c_nationkey END AS handle, CASE WHEN c_custkey % 70 = 0 THEN c_custkey END AS entity_id, ['r' || (c_custkey % 6)] AS refs FROM customer)
SELECT 'duplicate handle' AS fault, handle, count(*) AS n FROM (SELECT handle FROM e GROUP BY 1 HAVING count(*) > 1) GROUP BY ALL UNION ALL SELECT 'needs one of handle and entity', handle, count(*) FROM a WHERE (handle IS NULL) = (entity_id IS NULL) GROUP BY ALL
UNION ALL SELECT 'unknown handle', h, 1 FROM (SELECT DISTINCT unnest(refs) AS h FROM a UNION SELECT handle FROM a WHERE handle IS NOT NULL) WHERE h NOT IN (SELECT handle FROM e)
UNION ALL SELECT DISTINCT 'refers to what is not made yet', e.handle, 1 FROM (SELECT handle, seq, unnest(refs) AS r FROM e) e JOIN e m ON m.handle = r WHERE m.seq >= e.seq"""
)
def plan_faults(spark, d):
    """What is wrong with a plan of regions, nations and claims of customers: a handle given twice, one that nobody makes, entities that come too late."""
    r, n, c = tables(spark, d, "region", "nation", "customer")

    def h(prefix, column):
        return F.concat(F.lit(prefix), column.cast("string"))

    none = F.array().cast("array<string>")
    entities = r.select(h("r", F.col("r_regionkey")).alias("handle"), (F.col("r_regionkey") + 100).alias("seq"), none.alias("refs"))
    entities = entities.unionByName(n.select(h("n", F.col("n_nationkey")).alias("handle"), (F.col("n_nationkey") * 5).alias("seq"), F.array(h("r", F.col("n_regionkey"))).alias("refs")))
    entities = entities.unionByName(n.filter("n_nationkey = 3").select(F.lit("n3").alias("handle"), F.lit(999).alias("seq"), none.alias("refs")))
    k = F.col("c_custkey")
    said = c.select(F.when(k % 50 != 0, h("n", F.col("c_nationkey"))).alias("handle"), F.when(k % 70 == 0, k).alias("entity_id"), F.array(h("r", k % 6)).alias("refs"))
    return C.plan_faults(entities, said).groupBy("fault", "handle").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {CLAIMS_SQL}, c AS (SELECT *, source_id = 1 AND field_name = 'purchase' AND entity_id % 2 = 0 AS hit FROM claims)
SELECT claim_id, NOT coalesce(hit, false) AS is_active, CASE WHEN hit THEN 77 END AS retracted_by_changeset_id FROM c"""
)
def retracted_claims(spark, d):
    """Purchases of even users by one source, withdrawn under a changeset."""
    rows = event_claims(spark, d).withColumn("retracted_by_changeset_id", F.lit(None).cast("int"))
    targets = rows.filter("source_id = 1 AND field_name = 'purchase' AND entity_id % 2 = 0").select(*C.IDENTITY, "source_id").distinct()
    after, _ = C.retracted(rows, targets, 77)
    return after.select("claim_id", "is_active", "retracted_by_changeset_id")


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'), p AS (SELECT DISTINCT l_orderkey AS e, l_suppkey AS s FROM lineitem WHERE l_quantity >= 25)
SELECT e AS entity_id, 'supply|supplier:' || s AS claim_key FROM a WHERE e IN (SELECT e FROM p) AND (e, s) NOT IN (SELECT (e, s) FROM p)"""
)
def swept_relationships(spark, d):
    """Suppliers of an order that its source no longer names; orders that it doesn't speak of keep theirs."""
    li = table(spark, d, "lineitem")
    key = F.concat(F.lit("supply|supplier:"), F.col("l_suppkey").cast("string"))
    rows = li.select(F.lit("order").alias("entity_type"), F.col("l_orderkey").alias("entity_id"), F.lit("supply").alias("field_name"), key.alias("claim_key"), "l_shipdate", "l_quantity")
    active = rows.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")).drop("l_shipdate", "l_quantity").distinct()
    return C.stale(active, rows.filter("l_quantity >= 25"), ["supply"]).select("entity_id", "claim_key")


@query("SELECT p_partkey, 'p_brand' AS field_name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part WHERE p_size > 10")
def scalar_claims(spark, d):
    """Rows to claims, one a field that says something."""
    p = table(spark, d, "part").withColumn("name", F.when(F.col("p_size") > 10, F.col("p_name")).when(F.col("p_size") > 5, ""))
    return C.unpivoted(p, "p_partkey", ["p_brand", "p_size", "name"])


# --- writes


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber AS a, l_returnflag AS f, l_linenumber = 1 AS p FROM lineitem)
SELECT l_orderkey AS entity_id, 'media_attachment|category:' || f || '|media_asset:' || a AS claim_key, '{"category":"' || f || '","exists":true,"is_primary":' || p || ',"media_asset":' || a || '}' AS value FROM m WHERE f <> 'R'
UNION ALL SELECT l_orderkey, 'unknown', f FROM m WHERE f = 'R'"""
)
def media_attachments(spark, d):
    """Claims that attach media, and what has a category that nobody knows."""
    rows = table(spark, d, "lineitem").select(F.lit("order").alias("entity_type"), F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("asset_id"), F.col("l_returnflag").alias("category"), (F.col("l_linenumber") == 1).alias("is_primary"))
    good, unknown = Z.media_claims(rows, ["A", "N"])
    return good.select("entity_id", "claim_key", "value").unionByName(unknown.select("entity_id", F.lit("unknown").alias("claim_key"), F.col("category").alias("value")))


@query(
    """WITH old AS (SELECT c_nationkey AS s, c_custkey AS k, lower(regexp_replace(c_name, '[^0-9A-Za-z]+', ' ', 'g')) AS name FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT c_nationkey AS s, CASE WHEN c_custkey % 5 = 0 THEN 'slug-' || (c_custkey - 1) ELSE 'new-' || (c_custkey // 4) END AS slug, CASE WHEN c_custkey % 9 = 0 THEN '--' WHEN c_custkey % 3 = 0 THEN lower(regexp_replace(lag(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), '[^0-9A-Za-z]+', ' ', 'g')) ELSE 'fresh ' || (c_custkey // 30) END AS name FROM customer)
SELECT DISTINCT slug, 'slug taken' AS fault FROM new WHERE slug IN (SELECT 'slug-' || k FROM old) UNION SELECT slug, 'name taken' FROM new WHERE (s, name) IN (SELECT (s, name) FROM old)
UNION SELECT slug, 'slug given twice' FROM new GROUP BY slug HAVING count(*) > 1 UNION SELECT n.slug, 'name given twice' FROM new n JOIN (SELECT s, CASE WHEN name = '--' THEN '' ELSE name END AS x FROM new GROUP BY ALL HAVING count(*) > 1) t ON n.s = t.s AND (CASE WHEN n.name = '--' THEN '' ELSE n.name END IS NOT DISTINCT FROM t.x) AND t.x IS NOT NULL
UNION SELECT slug, 'no name' FROM new WHERE name = '--' OR name IS NULL"""
)
def creation_faults(spark, d):
    """Why new customers can't be created beside every other one that is there: slugs and names, within a nation, in whatever spelling."""
    from pyspark.sql import Window as W

    c, k = table(spark, d, "customer"), F.col("c_custkey")
    before = F.lag("c_name").over(W.partitionBy("c_nationkey").orderBy("c_custkey"))
    slug = F.when(k % 5 == 0, F.concat(F.lit("slug-"), (k - 1).cast("string"))).otherwise(F.concat(F.lit("new-"), F.floor(k / 4).cast("string")))
    name = F.when(k % 9 == 0, "--").when(k % 3 == 0, F.concat(F.lit("The "), F.upper(before))).otherwise(F.concat(F.lit("Fresh: "), F.floor(k / 30).cast("string")))
    new = c.select(F.col("c_nationkey").alias("s"), slug.alias("slug"), name.alias("name"))
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("s"), F.concat(F.lit("slug-"), k.cast("string")).alias("slug"), F.col("c_name").alias("name"))
    faults = Z.creation_faults(new, old, ["s"])
    # names that nobody has clash with no other
    return faults


@query(
    """WITH g AS (SELECT o_orderkey, lower(o_orderpriority) AS v FROM orders UNION ALL SELECT o_orderkey, lower(o_orderpriority) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'none ' || o_orderstatus FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey AS row, lower(v) AS value, 'given twice' AS fault FROM g GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT o_orderkey, lower(v), 'unknown' FROM g WHERE v NOT IN (SELECT lower(o_orderpriority) FROM orders)"""
)
def input_faults(spark, d):
    """Lists given by hand: priorities given twice, in another case, and values that there are not."""
    o = table(spark, d, "orders")
    given = o.select(F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("value"))
    given = given.unionByName(o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("row"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("value")))
    given = given.unionByName(o.filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("row"), F.concat(F.lit("None "), "o_orderstatus").alias("value")))
    return Z.input_faults(given, "row", "value", o.select("o_orderpriority").distinct(), "o_orderpriority")


@query("SELECT event_id, 9::BIGINT AS changeset_id, CASE WHEN event_id % 3 = 0 THEN 'own ' || event_id ELSE 'shared' END AS citation FROM events")
def joint_changesets(spark, d):
    """Claims of several entities under one changeset, with its citation where they have none."""
    e = table(spark, d, "events").withColumn("citation", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("own "), F.col("event_id").cast("string"))))
    return Z.joint_changeset(e, 9, "shared").select("event_id", "changeset_id", "citation")


@query(
    """WITH old AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'MOVED' END AS v FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(old.k, new.k) AS c_custkey, coalesce(new.v, old.v) AS segment, CASE WHEN old.k IS NULL THEN 'created' WHEN new.k IS NULL OR new.v = old.v THEN 'unchanged' ELSE 'updated' END AS status FROM old FULL JOIN new ON old.k = new.k"""
)
def upserted_rows(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    old = c.filter("c_custkey % 3 <> 0").select(k, F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_custkey % 4 <> 0").select(k, F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("MOVED").alias("segment"))
    return S.upserted(old, new, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'NEW' END AS segment FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def added_rows(spark, d):
    """Rows whose key is not there are added, the others ignored."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    old = c.filter("c_custkey % 3 <> 0").select(k, F.col("c_mktsegment").alias("segment"))
    return S.add_missing(old, c.filter("c_custkey % 2 = 0").select(k, F.lit("NEW").alias("segment")), ["c_custkey"])


@query("""SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS payload, md5('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}') AS etag FROM region""")
def tagged_payloads(spark, d):
    return S.tagged(table(spark, d, "region").select("r_regionkey", "r_name")).select("r_regionkey", "payload", "etag")


# --- resolution


@query("SELECT o_orderkey, 'closed without priority' AS broken FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE o_totalprice < 10000 OR o_totalprice > 400000")
def broken_rules(spark, d):
    rules = {"closed without priority": "o_orderstatus <> 'F' OR o_orderpriority <> '4-NOT SPECIFIED'", "price": "o_totalprice BETWEEN 10000 AND 400000"}
    return R.unclaimed_check(table(spark, d, "orders"), rules).select("o_orderkey", "broken")


@query(
    """WITH w AS (SELECT p_partkey AS e, lower(p_name) AS a, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS show FROM part WHERE p_size > 10), x AS (SELECT p_partkey AS e, lower(p_name) AS a, p_name AS show FROM part WHERE p_size < 40)
SELECT coalesce(w.e, x.e) AS entity_id, coalesce(w.a, x.a) AS alias, coalesce(w.show, x.show) AS display, CASE WHEN x.e IS NULL THEN 'create' WHEN w.e IS NULL THEN 'delete' WHEN w.show = x.show THEN 'keep' ELSE 'update' END AS action FROM w FULL JOIN x ON w.e = x.e AND w.a = x.a"""
)
def alias_table(spark, d):
    """Aliases from winning claims: lower-case keys, spellings that change, those that nobody says any more."""
    p = table(spark, d, "part")
    said = p.filter("p_size > 10").select(F.lower("p_name").alias("alias"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("display"), "p_partkey")
    won = said.select(F.lit("part").alias("entity_type"), F.col("p_partkey").alias("entity_id"), F.lit("alias").alias("field_name"), F.to_json(F.struct("alias", "display")).alias("value"))
    there = p.filter("p_size < 40").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("display"))
    return R.aliases_of(won, there)


@query("SELECT DISTINCT l_partkey AS entity_id, l_suppkey AS supplier FROM lineitem WHERE l_quantity >= 5")
def related_by_anyone(spark, d):
    """Suppliers of a part that any line says to exist, whatever others say."""
    value = F.to_json(F.struct((F.col("l_quantity") >= 5).alias("exists"), F.col("l_suppkey").alias("supplier")))
    rows = table(spark, d, "lineitem").select(F.lit("part").alias("entity_type"), F.col("l_partkey").alias("entity_id"), F.lit("supplier").alias("field_name"), value.alias("value"))
    return R.related_any(rows, "supplier", {"supplier": "bigint"}).select("entity_id", "supplier")


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey % 9 END, 5) >= 4 AS shown FROM supplier")
def license_threshold(spark, d):
    """Whether a licence of a rank, or of none, may be shown under a policy."""
    rank = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") % 9)
    return table(spark, d, "supplier").select("s_suppkey", R.displayable(rank, 4).alias("shown"))


@query("SELECT p_partkey, p_size < 5 AS p_size_low, p_size > 45 AS p_size_high, p_retailprice < 950 AS price_low FROM part WHERE p_size < 5 OR p_size > 45 OR p_retailprice < 950")
def outside_bounds(spark, d):
    """Parts outside the bounds that their specification tells forms about."""
    spec = EntitySpec("part", (FieldSpec("p_size", "int", least=5, most=45), FieldSpec("p_retailprice", "double", least=950), FieldSpec("p_name")))
    b = spec.constraints()
    low, high, price = F.col("p_size") < b["p_size"]["min"], F.col("p_size") > b["p_size"]["max"], F.col("p_retailprice") < b["p_retailprice"]["min"]
    return table(spark, d, "part").filter(low | high | price).select("p_partkey", low.alias("p_size_low"), high.alias("p_size_high"), price.alias("price_low"))


# --- what pages show


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 10 >= 4 THEN 'https://u/' || p_partkey WHEN p_partkey % 4 = 1 THEN 'https://l/' || p_partkey WHEN p_partkey % 4 = 2 THEN 'http://m/' || p_partkey
  WHEN p_partkey % 5 = 0 THEN 'https://f/' || p_partkey END AS image, CASE WHEN p_size % 2 = 0 AND p_size % 10 >= 5 THEN 'CC' ELSE 'PD' END AS license FROM part"""
)
def images_shown(spark, d):
    """The image of every part by the cascade of uploads, structured images and plain addresses, and the first licence that may be shown."""
    p, k, none = table(spark, d, "part"), F.col("p_partkey").cast("string"), F.lit(None).cast("string")

    def at(prefix):
        return F.concat(F.lit(prefix), k)

    upload = F.struct(F.when(F.col("p_size") % 2 == 0, "backglass").otherwise("other").alias("category"), at("https://u/").alias("url"), (F.col("p_size") % 10).alias("rank"))
    uploads = F.filter(F.array(upload), lambda _: F.col("p_size") % 3 == 0)
    n = F.col("p_partkey") % 4
    image = F.struct(F.lit(False).alias("primary"), F.when(n == 1, at("https://l/")).alias("large"), F.when(n == 2, at("http://m/")).alias("medium"), F.when(n == 3, at("rel/")).alias("small"), F.lit(None).cast("int").alias("rank"))
    images = F.filter(F.array(image), lambda _: n != 0)
    urls = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("rel"), at("https://f/"))).otherwise(F.array(none))
    license_ = D.attribution([(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.lit("CC"), F.col("p_size") % 10), (F.col("p_brand"), F.lit("PD"), F.lit(None).cast("int"))], 5)
    return p.select("p_partkey", D.chosen_image(uploads, images, urls, 4).alias("image"), license_["license"].alias("license"))


@query(
    f"""WITH {EFFECTIVE_SQL}, l(id, name, rank) AS (VALUES (1, 'CC', 6), (2, 'PD', 9))
SELECT entity_id, value, CASE WHEN source_id IS NOT NULL THEN 's' || source_id END AS source, l.name AS license, l.rank FROM ranked LEFT JOIN sources s USING (source_id) LEFT JOIN l ON l.id = s.license WHERE rn = 1 AND claim_key = 'view'"""
)
def text_attributions(spark, d):
    """Who the winning value of a field is from, with the licence that holds for it."""
    licenses = spark.createDataFrame([(1, "CC", 6), (2, "PD", 9)], "license_id int, name string, rank int")
    won = R.winners(effective(spark, d)).withColumn("license_id", F.lit(None).cast("int"))
    per_field = spark.createDataFrame([], "source_id bigint, field_name string, license_id int")
    licensed = R.effective_license(won, per_field, F.broadcast(sources(spark)))
    return D.text_attribution(licensed, F.broadcast(licenses), F.broadcast(sources(spark)), "view").select("entity_id", "value", "source", "license", "rank")


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END
  WHEN s < 604800 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END WHEN year(ts) = 2024 THEN strftime(ts, '%b %-d') ELSE strftime(ts, '%b %-d, %Y') END AS shown
FROM (SELECT event_id, ts, 1706745600 - floor(epoch(ts))::BIGINT AS s FROM events)"""
)
def relative_dates(spark, d):
    """How long ago, as of February 2024."""
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", D.relative_date(at, F.timestamp_seconds(F.lit(1706745600))).alias("shown"))


@query("SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, CASE WHEN event_id % 4 <> 0 THEN (event_id % 50 + 1950)::INT END AS other FROM events")
def dates_told(spark, d):
    """Year and month of dates as text; whole dates, and years alone that only the second reader takes."""
    e, text = table(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd")
    partial = F.when(F.col("event_id") % 4 != 0, F.concat((F.col("event_id") % 50 + 1950).cast("string"), F.lit("-06-01")))
    return e.select("event_id", V.dated(text)["year"].alias("year"), V.dated(text)["month"].alias("month"), V.dated(partial)["year"].alias("other"))


@query("""SELECT p_partkey, lower(p_name) || ' ' || lower(replace(p_brand, '#', '')) AS form, p_name AS base, CASE p_type WHEN 'PROMO' THEN 'Promotion' WHEN 'SMALL' THEN 'Little' ELSE p_type END AS kind,
  CASE WHEN p_size > 25 THEN 'whole' ELSE replace(p_name, ' ', '-') || ',' || lower(replace(p_brand, '#', '')) END AS themes FROM part""")
def name_displays(spark, d):
    """Search forms, names without their brackets, overridden labels, themes of a line."""
    p = table(spark, d, "part")
    long = F.concat("p_name", F.lit("  ("), "p_brand", F.lit(")"))
    themes = N.theme_slugs(F.concat("p_name", F.lit(" - "), "p_brand", F.lit(", "), "p_name"), F.when(F.col("p_size") > 25, "whole"))
    return p.select(
        "p_partkey", N.search_form(F.concat(F.upper("p_name"), F.lit("   "), "p_brand", F.lit("!"))).alias("form"), N.base_name(long).alias("base"),
        D.overridden(F.col("p_type"), {"PROMO": "Promotion", "SMALL": "Little"}, F.col("p_type")).alias("kind"), F.array_join(themes, ",").alias("themes"),
    )


@query("SELECT c_custkey, c_name || ' & <' || c_mktsegment || '> é' AS text FROM customer")
def unescaped_texts(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", V.unescaped(F.concat("c_name", F.lit(" &amp; &lt;"), "c_mktsegment", F.lit("&gt; &#233;"))).alias("text"))


@query("SELECT o_orderkey, (o_orderkey % 3 <> 2) AS same FROM orders")
def equal_json(spark, d):
    """Equal as values, whatever the order of keys and the blanks."""
    k = F.col("o_orderkey").cast("string")
    a = F.concat(F.lit('{"k":'), k, F.lit(',"s":"'), "o_orderstatus", F.lit('"}'))
    other = F.when(F.col("o_orderkey") % 3 == 0, a).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{ "s": "'), "o_orderstatus", F.lit('", "k": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"k":"'), k, F.lit('","s":"'), "o_orderstatus", F.lit('"}')))
    return table(spark, d, "orders").select("o_orderkey", D.same_json(a, other).alias("same"))


@query("SELECT o_orderkey, first(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def first_matching(spark, d):
    """The first line of an order that is a return, picked from the array of its lines."""
    o, li = tables(spark, d, "orders", "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("lines"))
    return o.select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", D.first_where(F.col("lines"), lambda x: x["l_returnflag"] == "R")["l_linenumber"].alias("line"))


@query(
    """WITH p AS (SELECT s_suppkey, r_name || '/' || n_name || '/' || (CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END) AS path, r_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN r_name ELSE r_name || '/' || n_name || '/debt/old' END AS other FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, path = other OR starts_with(path, other || '/') OR starts_with(other, path || '/') AS compatible FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN p ON s_suppkey = l_suppkey JOIN b ON c_custkey = o_custkey"""
)
def compatible_paths(spark, d):
    """Whether a supplier's place and a customer's are the same or one within the other."""
    li, o, c, n, r = tables(spark, d, "lineitem", "orders", "customer", "nation", "region")
    place = F.when(F.col("c_custkey") % 2 == 0, F.col("r_name")).otherwise(F.concat_ws("/", "r_name", "n_name", F.lit("debt"), F.lit("old")))
    homes = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", place.alias("other"))
    rows = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(homes, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(supplier_paths(spark, d), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", Y.compatible(F.col("path"), F.col("other")).alias("compatible"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(['n' || c_nationkey, 'r' || n_regionkey, 'world'])), ',') AS places FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expanded_places(spark, d):
    """Arrays of places with all that is above them."""
    c, n, r = tables(spark, d, "customer", "nation", "region")
    nation, region = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    edges = n.select(nation.alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent")).unionByName(r.select(region.alias("child"), F.lit("world").alias("parent")))
    docs = c.select("c_custkey", F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("places"))
    return Y.expanded(docs, "c_custkey", "places", Y.closure(edges)).select("c_custkey", F.array_join("places", ",").alias("places"))


@query(
    """WITH x AS (SELECT event_id, user_id, event_type, s, l FROM events, (VALUES (1, 'p. 1'), (2, 'p. 2'), (1, 'p. 1')) w(s, l) WHERE event_id % 3 = s OR s = 1)
SELECT user_id AS changeset_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS fields, array_to_string(list_sort(list(DISTINCT s || ':' || l)), ',') AS citations FROM x GROUP BY 1"""
)
def cited_changesets(spark, d):
    """Fields and distinct citations of every changeset that cites something."""
    e = table(spark, d, "events")
    w = F.array(*[F.struct(F.lit(s).alias("citation_source_id"), F.lit(x).alias("locator")) for s, x in ((1, "p. 1"), (2, "p. 2"), (1, "p. 1"))])
    citations = e.select(F.col("event_id").alias("claim_id"), F.inline(w)).filter("claim_id % 3 = citation_source_id OR citation_source_id = 1")
    claims = e.select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("changeset_id"), F.col("event_type").alias("field_name"))
    got = H.cited(claims, citations)
    shown = F.transform("citations", lambda c: F.concat_ws(":", c["citation_source_id"].cast("string"), c["locator"]))
    return got.select("changeset_id", F.array_join("fields", ",").alias("fields"), F.array_join(shown, ",").alias("citations"))


@query(
    f"""WITH {EFFECTIVE_SQL}, l(id, slug, rank) AS (VALUES (1, 'cc-by', 6), (2, 'pd', 9)), w AS (SELECT * FROM ranked WHERE rn = 1),
x AS (SELECT entity_id, 'signup=' || value AS e FROM w WHERE claim_key = 'signup' UNION ALL SELECT entity_id, 'error=' || value FROM w WHERE claim_key = 'error'
  UNION ALL SELECT entity_id, 'error.__license=' || slug FROM w JOIN sources s USING (source_id) JOIN l ON l.id = s.license WHERE claim_key = 'error' UNION ALL SELECT entity_id, 'error.__permissiveness_rank=' || rank FROM w JOIN sources s USING (source_id) JOIN l ON l.id = s.license WHERE claim_key = 'error')
SELECT entity_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS extra FROM (SELECT DISTINCT entity_id FROM w) LEFT JOIN x USING (entity_id) GROUP BY 1"""
)
def licensed_extras(spark, d):
    """Further claims of an entity as a map, with the licence of one of them beside it."""
    spec = EntitySpec("user", (FieldSpec("click"), FieldSpec("view"), FieldSpec("purchase")), extra=True)
    licenses = spark.createDataFrame([(1, "cc-by", 6), (2, "pd", 9)], "license_id int, slug string, rank int")
    won = R.winners(effective(spark, d)).withColumn("license_id", F.lit(None).cast("int"))
    won = R.effective_license(won, spark.createDataFrame([], "source_id bigint, field_name string, license_id int"), F.broadcast(sources(spark)))
    out = R.with_field_licenses(R.wide(won, spec), won, licenses, ("error",))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return out.select("entity_id", text.alias("extra"))


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS e, l_returnflag AS c, l_linenumber AS a FROM lineitem), x AS (SELECT *, a = min(a) OVER (PARTITION BY e, c) AS p FROM m), w AS (SELECT e, c, max(a) AS a FROM m GROUP BY ALL)
SELECT x.e AS entity_id, 'media_attachment|category:' || c || '|media_asset:' || x.a AS claim_key, '{"category":"' || c || '","exists":true,"is_primary":' || (x.a = w.a) || ',"media_asset":' || x.a || '}' AS value FROM x JOIN w USING (e, c) WHERE p <> (x.a = w.a)"""
)
def primary_claims(spark, d):
    """Claims that make the last asset of each order and category the primary one instead of the first."""
    li = table(spark, d, "lineitem")
    m = li.select(F.lit("order").alias("entity_type"), F.col("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("asset_id"))
    m = m.repartition(parts_for(li), "entity_id").distinct()
    group = ["entity_type", "entity_id", "category"]
    first = F.min("asset_id").over(W.partitionBy(*group))
    attached = stored(m.withColumn("is_primary", F.col("asset_id") == first), "attached")
    return Z.primary_claims(attached, attached.groupBy(*group).agg(F.max("asset_id").alias("asset_id")))[0].select("entity_id", "claim_key", "value")
