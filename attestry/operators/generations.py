"""Planned entities that name one another, and claims that name planned entities inside their keys.

A plan's entities have handle, seq, entity_type, identity (map of key parts) and refs (map of key part to the handle of another planned entity). An
entity's key is built from both, so it is known only once those it names have ids: ids are given generation by generation. An entity whose key
is there already gets the id it has, so that a plan applied again makes nothing; handles with equal keys are one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.specs import RelationshipSpec
from ._shared import stored
from .claims import escaped, numbered, relationship_claim

_NONE = "cast(map() AS map<string,string>)"


def key_of(name: Column, parts: Column) -> Column:
    """``name|a:1|b:x`` from a map, parts in name order."""
    sorted_ = F.array_sort(F.map_entries(parts))
    return F.concat_ws("|", name, F.transform(sorted_, lambda e: F.concat(e["key"], F.lit(":"), escaped(e["value"]))))


def _named(rows: DataFrame, by: list[str], made: DataFrame) -> DataFrame:
    """Rows with ``parts``: identity, and refs as far as they are ``made`` (handle, entity_id); ``missing`` counts the others."""
    ids = made.select(F.col("handle").alias("_ref"), "entity_id")
    each = rows.select(*by, F.explode("refs").alias("_part", "_ref")).join(ids, "_ref", "left")
    got = each.groupBy(*by).agg(
        F.count_if(F.col("entity_id").isNull()).alias("missing"),
        F.map_from_entries(F.collect_list(F.when(F.col("entity_id").isNotNull(), F.struct("_part", F.col("entity_id").cast("string").alias("id"))))).alias("_ids"),
    )
    out = rows.join(got, by, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    return out.withColumn("parts", F.map_concat(F.coalesce("identity", F.expr(_NONE)), F.coalesce("_ids", F.expr(_NONE)))).drop("_ids")


def with_ids(entities: DataFrame, existing: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(made: handle, entity_type, entity_id, entity_key, generation, is_new; stuck: handle, fault). ``existing`` has entity_key and entity_id.

    Ids go from ``next_id`` on by generation, then by the least seq of a key. Stuck are handles that name an unknown handle, are in a circle, or
    hang on such a one. Rounds follow the depth of the plan."""
    spark = entities.sparkSession
    left = stored(entities.select("handle", "seq", "entity_type", "identity", F.coalesce("refs", F.expr(_NONE)).alias("refs")), "plan")
    known = existing.select("entity_key", F.col("entity_id").alias("_old")).dropDuplicates(["entity_key"])
    made = spark.createDataFrame([], f"handle string, entity_type string, entity_id bigint, entity_key string, generation int, is_new boolean")
    generation = 0
    while True:
        ready = _named(left, ["handle"], made).filter("missing = 0").withColumn("entity_key", key_of(F.col("entity_type"), F.col("parts")))
        ready = stored(ready.join(known, "entity_key", "left").select("handle", "seq", "entity_type", "entity_key", "_old"), "ready")
        if ready.isEmpty():
            break
        fresh = numbered(ready.filter("_old IS NULL").groupBy("entity_key").agg(F.min("seq").alias("_seq")), ["_seq", "entity_key"])
        fresh = stored(fresh.select("entity_key", (F.col("number") + next_id - 1).alias("_new")), "fresh")
        rows = ready.join(fresh, "entity_key", "left")
        made = made.unionByName(rows.select("handle", "entity_type", F.coalesce("_old", "_new").cast("bigint").alias("entity_id"), "entity_key", F.lit(generation).alias("generation"), F.col("_old").isNull().alias("is_new")))
        made = stored(made, "made")
        next_id += fresh.count()
        left = stored(left.join(ready, "handle", "left_anti"), "plan")
        generation += 1
    handles = entities.select(F.col("handle").alias("_ref")).distinct()
    unknown = left.select("handle", F.explode(F.map_values("refs")).alias("_ref")).join(handles, "_ref", "left_anti").select("handle").distinct().withColumn("_u", F.lit(True))
    fault = F.when(F.col("_u"), "names an unknown handle").otherwise("in a circle, or hangs on a fault")
    return made, left.join(unknown, "handle", "left").select("handle", fault.alias("fault"))


def with_references(assertions: DataFrame, made: DataFrame, relationships: list[RelationshipSpec]) -> tuple[DataFrame, DataFrame]:
    """(claims, faults). Assertions have seq, entity_id or handle, field_name, value, and for relationships identity and refs (part to handle); key and
    value of a relationship are built from both in one go, so that they always agree. Faults are assertions whose own handle or a ref was not made."""
    rows = assertions.withColumn("refs", F.coalesce("refs", F.expr(_NONE)))
    own = made.select("handle", F.col("entity_id").alias("_own"))
    rows = _named(rows.join(own, "handle", "left").withColumn("entity_id", F.coalesce("entity_id", "_own")).drop("_own"), ["seq"], made)
    key, value = F.col("field_name"), F.col("value")
    for spec in relationships:
        typed = {k: F.col("parts")[k].try_cast("bigint" if t == "int" else t) for k, t in spec.identity.items()}
        own_key, own_value = relationship_claim(spec.namespace, typed)
        here = F.col("field_name") == spec.namespace
        key, value = F.when(here, own_key).otherwise(key), F.when(here, own_value).otherwise(value)
    bad = F.col("entity_id").isNull() | (F.col("missing") > 0)
    rows = rows.withColumns({"claim_key": key, "value": value})
    return rows.filter(~bad).drop("missing", "parts", "identity", "refs", "handle"), rows.filter(bad).select("seq", "handle", F.when(F.col("entity_id").isNull(), "its entity was not made").otherwise("names what was not made").alias("fault"))
