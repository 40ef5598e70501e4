"""Claims: keys, deduplication, validation, difference against what a source said before, sweeps, retraction, runs, changesets.

A claims table has claim_id, entity_type, entity_id, source_id or user_id, field_name, claim_key, value (canonical JSON or plain
text), citation, license_id, needs_review, needs_review_notes, is_active, created_at. Identity is (entity_type, entity_id, claim_key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import garbled
from ..plans.specs import EntitySpec, RelationshipSpec, violation
from ._shared import stored

IDENTITY = ("entity_type", "entity_id", "claim_key")
COMPARED = ("value", "citation", "needs_review", "needs_review_notes", "license_id")


def escaped(part: Column) -> Column:
    text = F.coalesce(part.cast("string"), F.lit("null"))
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("%", "%25"), ("|", "%7C"), (":", "%3A")), text)


def claim_key(field_name: Column, identity: dict[str, Column]) -> Column:
    """``field|a:1|b:x`` with parts in name order; the field itself without parts."""
    return F.concat_ws("|", field_name, *[F.concat(F.lit(f"{k}:"), escaped(identity[k])) for k in sorted(identity)])


def relationship_claim(namespace: str, identity: dict[str, Column], exists: Column | bool = True, payload: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """claim_key and canonical JSON value of a relationship."""
    exists = exists if isinstance(exists, Column) else F.lit(exists)
    parts = {**identity, **(payload or {}), "exists": exists}
    value = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    return claim_key(F.lit(namespace), identity), value


def exists_flag(value: Column) -> Column:
    """``exists`` of a relationship value, true where it isn't said."""
    return F.coalesce(F.get_json_object(value, "$.exists") == "true", F.lit(True))


def last_write(claims: DataFrame, order: str = "seq", keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The last row of each identity. ``max_by`` combines before the shuffle, which a window doesn't."""
    rest = [c for c in claims.columns if c not in keys]
    best = claims.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(*[F.col(f"row.{c}") if c in rest else F.col(c) for c in claims.columns])


def first_write(claims: DataFrame, order: str = "seq", keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    rest = [c for c in claims.columns if c not in keys]
    best = claims.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(*[F.col(f"row.{c}") if c in rest else F.col(c) for c in claims.columns])


def classified(claims: DataFrame, entities: list[EntitySpec], relationships: list[RelationshipSpec]) -> DataFrame:
    """Adds claim_class: direct (a field of the entity), relationship (a namespace that takes it as subject), extra, or unrecognized."""
    spark = claims.sparkSession
    rows = [(e.name, f.name, "direct") for e in entities for f in e.fields] + [(s, r.namespace, "relationship") for r in relationships for s in r.subjects]
    known = spark.createDataFrame(rows, "entity_type string, field_name string, known string")
    extra = F.col("entity_type").isin(*[e.name for e in entities if e.extra])
    out = claims.join(F.broadcast(known), ["entity_type", "field_name"], "left")
    return out.withColumn("claim_class", F.coalesce("known", F.when(extra, "extra").otherwise("unrecognized"))).drop("known")


_JSON_TYPES = {"string": "STRING", "int": "BIGINT", "boolean": "BOOLEAN"}


def relationship_fault(spec: RelationshipSpec) -> Column:
    """The first rule that a relationship claim breaks, null if none: subject, object, exists, required keys, exact types, unknown keys, key."""
    value = F.try_parse_json("value")
    kind = F.schema_of_variant(value)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))

    def typed(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))

    known = {**spec.identity, **spec.payload}
    out = F.when(~F.col("entity_type").isin(*spec.subjects), "subject").when(value.isNull() | ~kind.startswith("OBJECT"), "not an object")
    out = out.when(~F.coalesce(typed("exists") == "BOOLEAN", F.lit(False)), "exists")
    for k in spec.identity:
        out = out.when(~F.array_contains(keys, k), f"missing {k}")
    for k, t in known.items():
        fits = typed(k).isin(_JSON_TYPES[t]) if k in spec.identity else typed(k).isin(_JSON_TYPES[t], "VOID")
        out = out.when(F.array_contains(keys, k) & ~F.coalesce(fits, F.lit(False)), f"type of {k}")
    out = out.when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in [*known, "exists"]]))) > 0, "unknown key")
    parts = {k: F.get_json_object("value", f"$.{k}") for k in spec.identity}
    return out.when(F.col("claim_key") != claim_key(F.lit(spec.namespace), parts), "key")


def validated(claims: DataFrame, entities: list[EntitySpec], relationships: list[RelationshipSpec]) -> DataFrame:
    """Adds claim_class and reject_reason (null: valid)."""
    out = classified(claims, entities, relationships)
    reason = F.when(F.col("claim_class") == "unrecognized", "unrecognized field")
    # only text beyond ASCII of fields that hold text can have been decoded wrongly
    texts = [(e.name, f.name) for e in entities for f in e.fields if f.type == "string"]
    if texts:
        holds = F.struct("entity_type", "field_name").isin(*[F.struct(F.lit(e).alias("entity_type"), F.lit(f).alias("field_name")) for e, f in texts])
        suspect = F.when(holds & (F.col("claim_class") == "direct") & F.col("value").rlike(r"[^\x00-\x7F]"), F.col("value"))
        reason = F.coalesce(reason, F.when(garbled(suspect), "garbled"))
    for e in entities:
        for f in e.fields:
            here = (F.col("claim_class") == "direct") & (F.col("entity_type") == e.name) & (F.col("field_name") == f.name)
            reason = F.coalesce(reason, F.when(here, violation(f, F.col("value"))))
    for r in relationships:
        reason = F.coalesce(reason, F.when((F.col("claim_class") == "relationship") & (F.col("field_name") == r.namespace), relationship_fault(r)))
    return out.withColumn("reject_reason", reason)


def missing_targets(claims: DataFrame, target_key: Column, targets: DataFrame, key: str) -> DataFrame:
    """Claims whose target is not there; claims of absence (exists = false) need none."""
    named = claims.filter(exists_flag(F.col("value"))).withColumn("_target", target_key).filter("_target IS NOT NULL")
    return named.join(targets.select(F.col(key).alias("_target")), "_target", "left_anti").select(*claims.columns)


def difference(pending: DataFrame, active: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """Pending claims (one an identity) against one author's active ones: action is unchanged, create, or supersede (with old_claim_id)."""
    old = active.select(*[F.col(c) for c in IDENTITY], F.col("claim_id").alias("old_claim_id"), *[F.col(c).alias(f"_old_{c}") for c in compared])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in compared])
    action = F.when(F.col("old_claim_id").isNull(), "create").when(same, "unchanged").otherwise("supersede")
    return pending.join(old, list(IDENTITY), "left").withColumn("action", action).drop(*[f"_old_{c}" for c in compared])


def stale(active: DataFrame, pending: DataFrame, fields: list[str], scope: DataFrame | None = None) -> DataFrame:
    """Active claims of some fields that are no longer said, for the entities in ``scope`` (None: those that pending speaks of; an empty
    scope retracts nothing)."""
    within = (pending if scope is None else scope).select("entity_type", "entity_id").distinct()
    mine = active.filter(F.col("field_name").isin(*fields)).join(within, ["entity_type", "entity_id"], "left_semi")
    return mine.join(pending.select(*IDENTITY), list(IDENTITY), "left_anti")


def applied(claims: DataFrame, pending: DataFrame, source_id: int, sweep: list[str] | None = None, scope: DataFrame | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims after ``source_id`` has said ``pending``, counts by action). Saying the same again changes nothing.

    ``pending`` has the claims columns but claim_id and is_active, and seq; new ids follow ``top`` (the largest one there is) in identity order."""
    active = claims.filter((F.col("source_id") == source_id) & F.col("is_active"))
    deduped = last_write(pending)
    diff = difference(deduped, active)
    gone = diff.filter("action = 'supersede'").select(F.col("old_claim_id").alias("claim_id"))
    swept = stale(active, deduped, sweep, scope).select("claim_id") if sweep else gone.limit(0)
    closed = gone.withColumn("_by", F.lit("supersede")).unionByName(swept.withColumn("_by", F.lit("sweep")))
    new = diff.filter("action <> 'unchanged'").drop("action", "old_claim_id", "seq")
    after = claims.select(F.coalesce(F.max("claim_id"), F.lit(0))).scalar() if top is None else F.lit(top)
    new = numbered(new, list(IDENTITY)).withColumn("claim_id", (after + F.col("number")).cast("bigint")).drop("number").withColumns({"is_active": F.lit(True), "source_id": F.lit(source_id).cast("bigint")})
    kept = claims.join(closed.select("claim_id", F.lit(True).alias("_closed")), "claim_id", "left")
    kept = kept.withColumn("is_active", F.col("is_active") & F.col("_closed").isNull()).select(*claims.columns)
    counts = diff.groupBy("action").agg(F.count(F.lit(1)).alias("n")).unionByName(closed.filter("_by = 'sweep'").groupBy(F.col("_by").alias("action")).agg(F.count(F.lit(1)).alias("n")))
    return kept.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(claims.schema[c].dataType).alias(c) for c in claims.columns])), counts


def numbered(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``number`` from 1 in the order of columns, without one task for all rows: range partitions (as many as a shuffle has), sizes summed, places
    within. The ranges are stored once, as their bounds come from a sample and would differ each time they are made."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_inner", inner).join(F.broadcast(before), "_part").withColumn("number", F.col("_inner") + F.col("_before")).drop("_part", "_inner", "_before")


def retracted(claims: DataFrame, targets: DataFrame, changeset_id: int) -> tuple[DataFrame, DataFrame]:
    """(claims with the targets' active claims closed, targets that had none). Targets are identities with source_id."""
    keys = [*IDENTITY, "source_id"]
    hit = claims.join(targets.select(*keys, F.lit(True).alias("_hit")).distinct(), keys, "left")
    close = F.col("is_active") & F.col("_hit").isNotNull()
    out = hit.withColumn("retracted_by_changeset_id", F.when(close, F.lit(changeset_id)).otherwise(F.col("retracted_by_changeset_id"))).withColumn("is_active", F.col("is_active") & ~close)
    missing = targets.join(claims.filter("is_active").select(*keys), keys, "left_anti")
    return out.select(*claims.columns), missing


def changesets(claims: DataFrame, first_id: int = 1) -> DataFrame:
    """One changeset for each entity that is touched, numbered in entity order."""
    touched = claims.select("entity_type", "entity_id").distinct()
    return numbered(touched, ["entity_type", "entity_id"]).select("entity_type", "entity_id", (F.col("number") + first_id - 1).alias("changeset_id"))


def plan_faults(entities: DataFrame, assertions: DataFrame) -> DataFrame:
    """What is wrong with a plan before anything is written: (fault, handle). Entities have handle, seq and refs (handles of entities that must be
    made before them), assertions handle (of a planned entity) or entity_id, and refs (handles in their values)."""
    twice = entities.groupBy("handle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate handle").alias("fault"), "handle")
    both = assertions.filter("(handle IS NULL) = (entity_id IS NULL)").select(F.lit("needs one of handle and entity").alias("fault"), "handle")
    known = entities.select("handle").distinct()
    refs = assertions.select(F.explode("refs").alias("handle")).unionByName(assertions.filter("handle IS NOT NULL").select("handle")).distinct()
    unknown = refs.join(known, "handle", "left_anti").select(F.lit("unknown handle").alias("fault"), "handle")
    faults = twice.unionByName(both).unionByName(unknown)
    if "refs" in entities.columns:
        needs = entities.select("handle", "seq", F.explode("refs").alias("_ref"))
        made = entities.groupBy(F.col("handle").alias("_ref")).agg(F.min("seq").alias("_made"))
        early = needs.join(made, "_ref", "left").filter(F.col("_made").isNull() | (F.col("_made") >= F.col("seq")))
        faults = faults.unionByName(early.select(F.lit("refers to what is not made yet").alias("fault"), "handle").distinct())
    return faults


def with_handles(assertions: DataFrame, entities: DataFrame, next_id: int) -> DataFrame:
    """Planned entities get ids after ``next_id`` in the order of the plan; assertions on handles get theirs."""
    ids = numbered(entities.select("handle", "seq"), ["seq", "handle"]).select("handle", (F.col("number") + next_id - 1).alias("_new_id"))
    return assertions.join(ids, "handle", "left").withColumn("entity_id", F.coalesce("entity_id", "_new_id")).drop("_new_id")


def edits(current: DataFrame, wanted: DataFrame, keys: list[str], payload: list[str] | None = None) -> DataFrame:
    """Two versions of a relationship to claims: exists true for what is new or has another payload, false for what is gone."""
    payload = payload or []
    new = wanted.select(*keys, *[F.col(p).alias(f"_new_{p}") for p in payload], F.lit(True).alias("_wanted"))
    old = current.select(*keys, *payload, F.lit(True).alias("_had"))
    both = old.join(new, keys, "full_outer")
    changed = reduce(lambda a, b: a | b, [~F.col(p).eqNullSafe(F.col(f"_new_{p}")) for p in payload], F.lit(False))
    action = F.when(F.col("_had").isNull(), "create").when(F.col("_wanted").isNull(), "delete").when(changed, "update")
    out = both.withColumn("action", action).filter("action IS NOT NULL").withColumn("exists", F.col("_wanted").isNotNull())
    return out.select(*keys, *[F.when(F.col("_wanted").isNotNull(), F.col(f"_new_{p}")).otherwise(F.col(p)).alias(p) for p in payload], "action", "exists")


def restorable(claims: DataFrame) -> DataFrame:
    """For each author's identity without an active claim, the latest closed one that was not retracted: what a revert brings back."""
    who = F.coalesce(F.concat(F.lit("s"), F.col("source_id").cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    rows = claims.withColumn("_who", who)
    none = rows.groupBy(*IDENTITY, "_who").agg(F.max(F.col("is_active").cast("int")).alias("_live"), F.max_by(F.when(F.col("retracted_by_changeset_id").isNull(), F.col("claim_id")), F.when(F.col("retracted_by_changeset_id").isNull(), F.struct("created_at", "claim_id"))).alias("claim_id"))
    return none.filter("_live = 0 AND claim_id IS NOT NULL").select(*IDENTITY, "claim_id")


def unpivoted(rows: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """Typed rows to scalar claims: one row a field that says something, values as text."""
    text = rows.select(id_, *[F.col(f).cast("string").alias(f) for f in fields])
    return text.unpivot(id_, fields, "field_name", "value").filter("value IS NOT NULL AND value <> ''")
