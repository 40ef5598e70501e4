"""Claims, resolution and history, with ``events`` read as claims: the user is the entity, the type the key, the value the value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import claims as C
from ..operators import history as H
from ..operators import resolve as R
from ..operators._shared import shared_dir
from ..plans.specs import EntitySpec, FieldSpec
from ..sources.readers import table
from ..sources.store import ClaimStore
from ._registry import query

SOURCES = [(0, "s0", 10, True, 1), (1, "s1", 30, True, None), (2, "s2", 30, True, 2), (3, "s3", 90, False, 3)]
#: events as claims, in SQL: source by event_id mod 5 (4: a user's own claim)
CLAIMS_SQL = """claims AS (SELECT event_id AS claim_id, 'user' AS entity_type, user_id AS entity_id, CASE WHEN event_id % 5 < 4 THEN event_id % 5 END AS source_id,
  CASE WHEN event_id % 5 = 4 THEN user_id END AS user_id, event_type AS claim_key, event_type AS field_name, CAST(CAST(round(value) AS INT) AS VARCHAR) AS value, ts AS created_at FROM events)"""
SOURCES_SQL = "sources(source_id, priority, is_enabled, license) AS (VALUES (0, 10, true, 1), (1, 30, true, NULL), (2, 30, true, 2), (3, 90, false, 3))"
EFFECTIVE_SQL = f"""{CLAIMS_SQL}, {SOURCES_SQL},
eff AS (SELECT c.*, CASE WHEN c.source_id IS NOT NULL THEN s.priority WHEN c.user_id IS NOT NULL THEN 20 ELSE 0 END AS priority
  FROM claims c LEFT JOIN sources s USING (source_id) WHERE c.source_id IS NULL OR s.is_enabled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, claim_key ORDER BY priority DESC, created_at DESC, claim_id DESC) AS rn FROM eff)"""


def event_claims(spark: SparkSession, d: str) -> DataFrame:
    e, five = table(spark, d, "events"), F.col("event_id") % 5
    return e.select(
        F.col("event_id").alias("claim_id"), F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.when(five < 4, five).alias("source_id"),
        F.when(five == 4, F.col("user_id")).alias("user_id"), F.col("event_type").alias("claim_key"), F.col("event_type").alias("field_name"),
        F.round("value").cast("int").cast("string").alias("value"), F.col("ts").alias("created_at"), F.lit(True).alias("is_active"),
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_id bigint, slug string, priority int, is_enabled boolean, default_license_id int")


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().withColumn("priority", F.lit(20))


def effective(spark: SparkSession, d: str) -> DataFrame:
    return R.effective(event_claims(spark, d), F.broadcast(sources(spark)), users(spark, d))


@query(f"WITH {EFFECTIVE_SQL} SELECT entity_id, claim_key, claim_id, value, priority FROM ranked WHERE rn = 1")
def claim_winners(spark, d):
    return R.winners(effective(spark, d)).select("entity_id", "claim_key", "claim_id", "value", "priority")


@query(f"WITH {EFFECTIVE_SQL} SELECT entity_id, claim_key, claim_id, rn = 1 AS is_winner FROM ranked")
def winner_flags(spark, d):
    return R.flagged(effective(spark, d)).select("entity_id", "claim_key", "claim_id", "is_winner")


USER = EntitySpec("user", (FieldSpec("click", "int", 0), FieldSpec("view", "string", ""), FieldSpec("purchase", "decimal(8,2)"), FieldSpec("signup", "boolean", False)), extra=True)


@query(
    f"""WITH {EFFECTIVE_SQL}, w AS (SELECT * FROM ranked WHERE rn = 1)
SELECT entity_id, coalesce(max(CASE WHEN claim_key = 'click' THEN CAST(value AS INT) END), 0) AS click, coalesce(max(CASE WHEN claim_key = 'view' THEN value END), '') AS "view",
  max(CASE WHEN claim_key = 'purchase' THEN CAST(value AS INT) END)::INT AS purchase, coalesce(max(CASE WHEN claim_key = 'signup' THEN value IN ('1') END), false) AS signup,
  coalesce(string_agg(CASE WHEN claim_key NOT IN ('click', 'view', 'purchase', 'signup') THEN claim_key || '=' || value END, ',' ORDER BY claim_key), '') AS extra
FROM w GROUP BY entity_id"""
)
def resolve_wide(spark, d):
    out = R.wide(R.winners(effective(spark, d)), USER)
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.withColumns({"extra": F.coalesce(extra, F.lit("")), "purchase": F.col("purchase").cast("int")})


@query(
    f"""WITH {EFFECTIVE_SQL}, w AS (SELECT * FROM ranked WHERE rn = 1 AND claim_key = 'purchase')
SELECT c_custkey AS entity_id, coalesce(w.value, c_name) AS label FROM customer LEFT JOIN w ON w.entity_id = c_custkey"""
)
def resolve_preserving(spark, d):
    """A field that keeps its former value where nobody claims it."""
    spec = EntitySpec("user", (FieldSpec("label", preserve=True),))
    won = R.winners(effective(spark, d)).filter("claim_key = 'purchase'").withColumn("claim_key", F.lit("label"))
    before = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("label"))
    return R.wide(won, spec, before)


@query(
    f"""WITH {EFFECTIVE_SQL}, fl(source_id, field_name, license_id) AS (VALUES (0, 'click', 7), (2, 'view', 8))
SELECT claim_id, coalesce(fl.license_id, s.license) AS effective_license_id FROM claims c LEFT JOIN sources s USING (source_id) LEFT JOIN fl USING (source_id, field_name)"""
)
def effective_license(spark, d):
    per_field = spark.createDataFrame([(0, "click", 7), (2, "view", 8)], "source_id bigint, field_name string, license_id int")
    c = event_claims(spark, d).withColumn("license_id", F.lit(None).cast("int"))
    return R.effective_license(c, F.broadcast(per_field), F.broadcast(sources(spark))).select("claim_id", "effective_license_id")


_HALF = "TIMESTAMP '2024-01-16 00:00:00'"
BATCHES_SQL = f"""a AS (SELECT user_id AS entity_id, event_type AS claim_key, arg_max(round(value)::INT, ts) AS value FROM events WHERE ts < {_HALF} GROUP BY ALL),
b AS (SELECT user_id AS entity_id, event_type AS claim_key, arg_max(round(value)::INT, ts) AS value FROM events WHERE ts >= {_HALF} GROUP BY ALL)"""


def batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What one source said before mid-January (active claims) and says after it."""
    e = table(spark, d, "events").withColumn("seq", F.col("ts"))
    e = e.select("event_id", "ts", "seq", F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("claim_key"), F.col("event_type").alias("field_name"), F.round("value").cast("int").alias("value"))
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old, new = C.last_write(e.filter(F.col("ts") < half)), C.last_write(e.filter(F.col("ts") >= half))
    return old.withColumn("claim_id", F.col("event_id")).drop("seq"), new.drop("event_id", "ts")


@query(
    f"""WITH {BATCHES_SQL} SELECT entity_id, claim_key, CASE WHEN a.entity_id IS NULL THEN 'create' WHEN a.value = b.value THEN 'unchanged' ELSE 'supersede' END AS action
FROM b LEFT JOIN a USING (entity_id, claim_key)"""
)
def claim_diff_actions(spark, d):
    old, new = batches(spark, d)
    return C.difference(new, old, ("value",)).select("entity_id", "claim_key", "action")


@query(
    f"""WITH {BATCHES_SQL} SELECT CASE WHEN a.entity_id IS NULL THEN 'create' WHEN a.value = b.value THEN 'unchanged' ELSE 'supersede' END AS action, count(*) AS n
FROM b LEFT JOIN a USING (entity_id, claim_key) GROUP BY 1"""
)
def claim_run_metrics(spark, d):
    old, new = batches(spark, d)
    return C.difference(new, old, ("value",)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BATCHES_SQL} SELECT entity_id, claim_key FROM a WHERE claim_key IN ('click', 'view') AND entity_id IN (SELECT entity_id FROM b) AND (entity_id, claim_key) NOT IN (SELECT (entity_id, claim_key) FROM b)")
def claim_sweep(spark, d):
    old, new = batches(spark, d)
    return C.stale(old, new, ["click", "view"]).select("entity_id", "claim_key")


LIVE_SQL = f"""WITH {BATCHES_SQL}, live AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.entity_id = a.entity_id AND b.claim_key = a.claim_key AND b.value <> a.value)
  UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.entity_id = a.entity_id AND b.claim_key = a.claim_key AND b.value = a.value))"""
COLUMNS = ["claim_id", "entity_type", "entity_id", "source_id", "field_name", "claim_key", "value", "citation", "needs_review", "needs_review_notes", "license_id", "is_active"]


def as_pending(rows: DataFrame) -> DataFrame:
    blank = {"citation": F.lit(""), "needs_review": F.lit(False), "needs_review_notes": F.lit(""), "license_id": F.lit(None).cast("bigint"), "source_id": F.lit(1).cast("bigint")}
    return rows.withColumns(blank).withColumn("value", F.col("value").cast("string"))


@query(f"{LIVE_SQL} SELECT entity_id, claim_key, value::VARCHAR AS value FROM live")
def claim_apply(spark, d):
    """Active claims after the second batch was applied to the first."""
    old, new = batches(spark, d)
    log = as_pending(old).withColumn("is_active", F.lit(True)).select(*COLUMNS)
    pending = as_pending(new).select(*[c for c in COLUMNS if c not in ("claim_id", "is_active")], "seq")
    after, _ = C.applied(log, pending, 1)
    return after.filter("is_active").select("entity_id", "claim_key", "value")


def store_of(spark: SparkSession, d: str) -> ClaimStore:
    """Both batches in a store of its own, one version each."""
    old, new = batches(spark, d)
    store = ClaimStore(spark, f"{shared_dir(spark)}/attestry-store-{uuid.uuid4().hex}", buckets=16)
    for rows in (old.withColumn("seq", F.col("ts")), new):
        store.apply(as_pending(rows).select(*[c for c in COLUMNS if c not in ("claim_id", "source_id", "is_active")], "seq"), source_id=1)
    return store


@query(f"{LIVE_SQL} SELECT entity_id, claim_key, value::VARCHAR AS value FROM live")
def claim_store(spark, d):
    """As :func:`claim_apply`, by two committed versions of a bucketed store."""
    return store_of(spark, d).read("claims").filter("is_active").select("entity_id", "claim_key", "value")


@query(
    f"""WITH {BATCHES_SQL},
  t AS (SELECT e AS entity_id, count(*) AS made, count(p) AS closed FROM (SELECT b.entity_id AS e, a.entity_id AS p FROM b LEFT JOIN a USING (entity_id, claim_key) WHERE a.entity_id IS NULL OR a.value <> b.value) GROUP BY 1),
  f AS (SELECT entity_id, count(*) AS made, 0 AS closed FROM a GROUP BY 1)
SELECT row_number() OVER (ORDER BY entity_id) AS changeset_id, 1::BIGINT AS version, entity_id, made, closed FROM f
UNION ALL SELECT (SELECT count(*) FROM f) + row_number() OVER (ORDER BY entity_id), 2, entity_id, made, closed FROM t"""
)
def claim_store_changesets(spark, d):
    """One changeset an entity and version, with how many claims it made and closed."""
    return store_of(spark, d).read("changesets").select("changeset_id", "version", "entity_id", "made", "closed")


@query(
    """SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1"""
)
def dedupe_last_write(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("seq", F.struct("ts", "event_id"))
    return C.last_write(e, keys=("user_id", "event_type", "day")).select("user_id", "event_type", "day", "event_id")


@query("SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first_write(spark, d):
    e = table(spark, d, "events").withColumn("seq", F.struct("ts", "event_id"))
    return C.first_write(e, keys=("user_id", "event_type")).select("user_id", "event_type", "event_id")


@query(f"WITH {CLAIMS_SQL} SELECT claim_id, value, lag(value) OVER (PARTITION BY entity_id, claim_key ORDER BY created_at, claim_id) AS previous FROM claims")
def claim_history_lag(spark, d):
    return H.with_previous(event_claims(spark, d)).select("claim_id", "value", "previous")


@query(
    f"""WITH {CLAIMS_SQL} SELECT entity_id, claim_key, claim_id FROM (SELECT *, CASE WHEN claim_id % 4 = 0 THEN NULL ELSE claim_id END AS ok, bool_or(claim_id % 7 = 0) OVER (PARTITION BY entity_id, claim_key, source_id, user_id) AS live
  FROM claims) WHERE NOT live AND ok IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id, claim_key, source_id, user_id ORDER BY created_at DESC, claim_id DESC) = 1"""
)
def predecessor_restore(spark, d):
    c = event_claims(spark, d).withColumns({"is_active": F.col("claim_id") % 7 == 0, "retracted_by_changeset_id": F.when(F.col("claim_id") % 4 == 0, F.lit(1))})
    return C.restorable(c).select("entity_id", "claim_key", "claim_id")


@query(
    """SELECT p_partkey, 'part|brand:' || replace(replace(replace(p_brand, '%', '%25'), '|', '%7C'), ':', '%3A') || '|size:' || p_size || '|type:' ||
  replace(replace(replace(p_type || ':%|', '%', '%25'), '|', '%7C'), ':', '%3A') AS claim_key FROM part"""
)
def claim_key_build(spark, d):
    key = C.claim_key(F.lit("part"), {"type": F.concat("p_type", F.lit(":%|")), "brand": F.col("p_brand"), "size": F.col("p_size")})
    return table(spark, d, "part").select("p_partkey", key.alias("claim_key"))


@query("""SELECT l_orderkey, l_partkey, '{"count":' || max(l_quantity)::INT || ',"exists":true,"part":' || l_partkey || '}' AS value, 'line|part:' || l_partkey AS claim_key FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2""")
def relationship_claims(spark, d):
    """Only lines of quantity above 45; :func:`relationship_claims_all` takes every line."""
    return _relationship_claims(table(spark, d, "lineitem").filter("l_quantity > 45"))


@query("""SELECT l_orderkey, l_partkey, '{"count":' || max(l_quantity)::INT || ',"exists":true,"part":' || l_partkey || '}' AS value, 'line|part:' || l_partkey AS claim_key FROM lineitem GROUP BY 1, 2""")
def relationship_claims_all(spark, d):
    return _relationship_claims(table(spark, d, "lineitem"))


def _relationship_claims(lines):
    rows = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").cast("int").alias("q"))
    key, value = C.relationship_claim("line", {"part": F.col("l_partkey")}, True, {"count": F.col("q")})
    return rows.select("l_orderkey", "l_partkey", value.alias("value"), key.alias("claim_key"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS exists_flag FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT), event_id % 3 <> 0 FROM events WHERE event_id % 2 = 1""")
def json_exists_default(spark, d):
    e = table(spark, d, "events")
    said = F.concat(F.regexp_replace("props", "}$", ""), F.lit(', "exists": '), F.when(F.col("event_id") % 3 != 0, "true").otherwise("false"), F.lit("}"))
    e = e.withColumn("props", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(said))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), C.exists_flag(F.col("props")).alias("exists_flag"))


_SETS = "h1 AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL), h2 AS (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY ALL)"


def supplied(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"), "l_shipdate")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    return [li.filter(c).groupBy("s", "p").agg(F.sum("q").alias("q")) for c in (F.col("l_shipdate") < cut, F.col("l_shipdate") >= cut)]


@query(f"WITH {_SETS} SELECT coalesce(h1.s, h2.s) AS s, coalesce(h1.p, h2.p) AS p, CASE WHEN h2.s IS NOT NULL THEN h2.q ELSE h1.q END AS q, CASE WHEN h1.s IS NULL THEN 'create' WHEN h2.s IS NULL THEN 'delete' WHEN h1.q = h2.q THEN 'keep' ELSE 'update' END AS action FROM h1 FULL JOIN h2 ON h1.s = h2.s AND h1.p = h2.p")
def m2m_diff(spark, d):
    old, new = supplied(spark, d)
    return R.materialization(new, old, ["s", "p"], ["q"])


@query(f"WITH {_SETS} SELECT coalesce(h1.s, h2.s) AS s, coalesce(h1.p, h2.p) AS p, CASE WHEN h2.s IS NOT NULL THEN h2.q ELSE h1.q END AS q, CASE WHEN h1.s IS NULL THEN 'create' WHEN h2.s IS NULL THEN 'delete' ELSE 'update' END AS action, h2.s IS NOT NULL AS \"exists\" FROM h1 FULL JOIN h2 ON h1.s = h2.s AND h1.p = h2.p WHERE h1.q IS DISTINCT FROM h2.q")
def edit_planner(spark, d):
    old, new = supplied(spark, d)
    return C.edits(old, new, ["s", "p"], ["q"])


@query("SELECT user_id AS entity_id, row_number() OVER (ORDER BY user_id) + 99 AS changeset_id FROM (SELECT DISTINCT user_id FROM events)")
def changeset_numbers(spark, d):
    return C.changesets(event_claims(spark, d), 100).select("entity_id", "changeset_id")


@query("SELECT o_orderkey AS entity_id, o_orderstatus AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderkey) > 1")
def unique_conflict_losers(spark, d):
    o = table(spark, d, "orders").withColumn("slug", F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderstatus"))
    had = o.select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("slug")).alias("slug"))
    return R.conflicts(o.select(F.col("o_orderkey").alias("entity_id"), "slug"), had, "slug").select("entity_id", F.substring_index("value", ":", -1).alias("value"))


#: customers of a ten want each the name of the next; the last keeps its own (all go back), or in every third ten takes a new one; some want one name
_WANTS = """w AS (SELECT c_custkey AS k, c_name AS had, CASE WHEN c_custkey % 10 = 9 THEN CASE WHEN (c_custkey // 10) % 3 = 0 THEN 'New ' || c_name ELSE c_name END WHEN c_custkey % 100 IN (42, 44) THEN 'Both ' || c_custkey // 100
  ELSE coalesce(lead(c_name) OVER (ORDER BY c_custkey), c_name) END AS want FROM customer),
own AS (SELECT want, arg_min(k, (CASE WHEN had = want THEN 0 ELSE 1 END, k)) AS k FROM w GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {_WANTS}, lost(k) AS (SELECT k FROM w WHERE k NOT IN (SELECT k FROM own) UNION SELECT x.k FROM lost JOIN w l ON l.k = lost.k JOIN own ON own.want = l.had JOIN w x ON x.k = own.k AND x.had <> x.want)
SELECT k AS entity_id, CASE WHEN k IN (SELECT k FROM lost) THEN had ELSE want END AS name, CASE WHEN k IN (SELECT k FROM lost) THEN 'reverted' ELSE 'kept' END AS outcome FROM w"""
)
def displacement_chains(spark, d):
    c, k = table(spark, d, "customer").withColumn("name", F.col("c_name")), F.col("c_custkey")
    after = c.select((k - 1).alias("c_custkey"), F.col("c_name").alias("_next"))
    last = F.when((k / 10).cast("bigint") % 3 == 0, F.concat(F.lit("New "), "c_name")).otherwise(F.col("c_name"))
    both = F.concat(F.lit("Both "), (k / 100).cast("bigint").cast("string"))
    want = F.when(k % 10 == 9, last).when((k % 100).isin(42, 44), both).otherwise(F.coalesce("_next", "c_name"))
    rows = c.join(after, "c_custkey", "left").select(k.alias("entity_id"), want.alias("name"))
    return R.settled(rows, c.select(k.alias("entity_id"), "name"), "name")


@query(
    """SELECT l_orderkey AS entity_id, l_linenumber AS asset_id, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY (l_discount >= 0.08) DESC,
  CASE WHEN l_discount >= 0.08 THEN -l_quantity END, l_shipdate, l_linenumber) = 1 AS is_primary FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"""
)
def primary_media(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_quantity", "l_shipdate")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    m = li.select(F.lit("order").alias("entity_type"), F.col("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("asset_id"), (F.col("l_discount") >= 0.08).alias("is_primary"), F.col("l_quantity").alias("priority"), F.col("l_shipdate").alias("created_at"))
    return R.primary_media(m).select("entity_id", "asset_id", "is_primary")


@query("SELECT user_id AS entity_id, event_type AS claim_key, CASE WHEN count(DISTINCT round(value)::INT) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'agreed' ELSE 'single' END AS state FROM events GROUP BY 1, 2")
def source_agreement(spark, d):
    from ..operators.aggregates import field_agreement

    return field_agreement(event_claims(spark, d)).select("entity_id", "claim_key", "state")


@query(
    f"""WITH {CLAIMS_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, claim_key ORDER BY created_at, claim_id) AS old FROM claims)
SELECT entity_id, CAST(created_at AS DATE) AS day, string_agg(claim_key || ':' || coalesce(old, '-') || '>' || value, ',' ORDER BY created_at DESC, claim_id DESC) AS changes FROM p GROUP BY 1, 2"""
)
def edit_history(spark, d):
    c = event_claims(spark, d).withColumn("changeset_id", F.to_date("created_at"))
    text = F.array_join(F.transform("changes", lambda x: F.concat(x["field_name"], F.lit(":"), F.coalesce(x["old"], F.lit("-")), F.lit(">"), x["new"])), ",")
    return H.changes(c).select("entity_id", F.col("changeset_id").alias("day"), text.alias("changes"))


@query("SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS units, max(ts) AS last_at FROM events GROUP BY 1, 2")
def contributions(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return H.contributions(e, "user_id", "event_type", "day", "ts")


@query(
    """SELECT event_id AS changeset_id, ts AS created_at, c_name AS name, 1 AS claims FROM events LEFT JOIN customer ON user_id = c_custkey
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"""
)
def change_feed(spark, d):
    c = event_claims(spark, d).withColumn("changeset_id", F.col("claim_id"))
    sets = table(spark, d, "events").select(F.col("event_id").alias("changeset_id"), F.col("ts").alias("created_at"))
    names = H.names_of(user=table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")))
    ntz = T.TimestampNTZType()
    got = H.feed(sets, c.drop("created_at"), names, "user", F.lit("2024-01-05").cast(ntz), F.lit("2024-01-20").cast(ntz))
    return got.select("changeset_id", "created_at", "name", "claims")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS allowed, [t] AS kept, NULL::INT AS retry_after FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(k) < 5, CASE WHEN len(k) < 5 THEN list_append(k, t) ELSE k END, CASE WHEN len(k) >= 5 THEN ceil((k[1] + 86400000000 - t) / 1000000)::INT END
  FROM (SELECT e.*, list_filter(r.kept, lambda x: x > e.t - 86400000000) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS "user", event_id AS id, allowed, retry_after FROM r"""
)
def rate_limit_decisions(spark, d):
    from ..streaming.jobs import rate_limited

    return rate_limited(table(spark, d, "events"), "user_id", "ts", "event_id", limit=5, seconds=86_400)


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS window_start, 0 AS used, CASE WHEN good THEN 1 ELSE 0 END AS after FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, window_start, used, CASE WHEN used < 3 AND good THEN used + 1 ELSE used END
  FROM (SELECT e.user_id, e.event_id, e.n, e.good, CASE WHEN e.t >= r.window_start + 86400000000 THEN e.t ELSE r.window_start END AS window_start, CASE WHEN e.t >= r.window_start + 86400000000 THEN 0 ELSE r.after END AS used
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS "user", event_id AS id, window_start, used, used < 3 AS allowed FROM r"""
)
def counter_decisions(spark, d):
    """Three good requests a user in a day that begins with the first; errors don't count."""
    from ..streaming.jobs import counted

    e = table(spark, d, "events").withColumn("good", F.col("event_type") != "error")
    return counted(e, "user_id", "ts", "event_id", limit=3, seconds=86_400, good="good")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def roll_window_counts(spark, d):
    from ..streaming.jobs import window_counts

    return window_counts(table(spark, d, "events"), "user_id", "ts")
