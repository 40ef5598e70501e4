"""Writes: creation with scoped checks, soft deletion with cascade and blockers, restoration, media as claims, metadata of the registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import collision_form
from ..plans.specs import EntitySpec
from ._shared import stored
from .claims import numbered, relationship_claim


@dataclass(frozen=True)
class Reference:
    """Rows of ``entity`` refer to rows of ``target`` by ``column``; ``cascade``: they go with it, else they block it."""

    entity: str
    column: str
    target: str
    cascade: bool


def cascade(tables: dict[str, DataFrame], references: list[Reference], start: DataFrame) -> DataFrame:
    """``start`` (entity, id) and all that goes with it: (entity, id, depth), each once, at its least depth. Rounds follow the depth of the registry."""
    seen = stored(start.select("entity", "id", F.lit(0).alias("depth")).distinct(), "cascade")
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        found = None
        for r in references:
            if r.cascade:
                up = front.filter(F.col("entity") == r.target).select(F.col("id").alias(r.column))
                rows = tables[r.entity].join(up, r.column, "left_semi").select(F.lit(r.entity).alias("entity"), "id")
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            break
        front = stored(found.distinct().join(seen, ["entity", "id"], "left_anti").withColumn("depth", F.lit(depth)), "cascade")
        seen = seen.unionByName(front)
    return seen


def in_order(members: DataFrame) -> DataFrame:
    """``place`` from 1: by depth, then entity and id, so that whoever is named first goes first and reruns agree."""
    return numbered(members, ["depth", "entity", "id"]).withColumnRenamed("number", "place")


def referrers(tables: dict[str, DataFrame], references: list[Reference], targets: DataFrame) -> DataFrame:
    """Who refers to ``targets`` (entity, id) without going with them: (entity, id, column, target, target_id)."""
    out = None
    for r in references:
        if not r.cascade:
            of = targets.filter(F.col("entity") == r.target).select(F.col("id").alias("target_id"))
            rows = tables[r.entity].join(of, F.col(r.column) == F.col("target_id"))
            rows = rows.select(F.lit(r.entity).alias("entity"), "id", F.lit(r.column).alias("column"), F.lit(r.target).alias("target"), "target_id")
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def deletion(tables: dict[str, DataFrame], references: list[Reference], start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members in order, blockers): blockers refer to a member and are no member. What has blockers must not be deleted."""
    members = cascade(tables, references, start)
    blockers = referrers(tables, references, members).join(members.select("entity", "id"), ["entity", "id"], "left_anti")
    return in_order(members), blockers


def restorable_rows(rows: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Deleted rows with whether they may come back: their parent, if they have one, must be there and active."""
    up = parents.select(F.col("id").alias("_p"), (F.coalesce("status", F.lit("active")) == "active").alias("_up"))
    both = rows.filter("status = 'deleted'").join(up, F.col(parent) == F.col("_p"), "left")
    return both.withColumn("may_restore", F.col(parent).isNull() | F.coalesce("_up", F.lit(False))).drop("_p", "_up")


def creation_faults(new: DataFrame, existing: DataFrame, scope: list[str], name: str = "name", slug: str = "slug") -> DataFrame:
    """Why new rows can't be created: (slug, fault). Slugs are unique at all, names in their normal form within ``scope``; new rows are also
    held against one another. Ids of new rows are their slugs."""
    mine = new.select(*scope, F.col(slug).alias("_slug"), collision_form(F.col(name)).alias("_name"))
    theirs = existing.select(*scope, F.col(slug).alias("_slug"), collision_form(F.col(name)).alias("_name"))
    taken = mine.join(theirs.select("_slug").distinct(), "_slug", "left_semi").select("_slug", F.lit("slug taken").alias("fault"))
    named = mine.join(theirs.select(*scope, "_name").distinct(), [*scope, "_name"], "left_semi").select("_slug", F.lit("name taken").alias("fault"))
    twice = mine.groupBy("_slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_slug", F.lit("slug given twice").alias("fault"))
    alike = mine.groupBy(*scope, "_name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("_slug").alias("_s")).filter("n > 1").select(F.explode("_s").alias("_slug"), F.lit("name given twice").alias("fault"))
    blank = mine.filter("_name = '' OR _name IS NULL").select("_slug", F.lit("no name").alias("fault"))
    return taken.unionByName(named).unionByName(twice).unionByName(alike).unionByName(blank).select(F.col("_slug").alias(slug), "fault").distinct()


def media_claims(media: DataFrame, categories: list[str], attached: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (entity_type, entity_id, asset_id, category, is_primary) to claims of attachment or detachment, and the rows whose category is unknown."""
    known = F.col("category").isin(*categories)
    key, value = relationship_claim("media_attachment", {"media_asset": F.col("asset_id"), "category": F.col("category")}, attached, {"is_primary": F.col("is_primary")})
    good = media.filter(known).select("entity_type", "entity_id", F.lit("media_attachment").alias("field_name"), key.alias("claim_key"), value.alias("value"))
    return good, media.filter(~F.coalesce(known, F.lit(False)))


def primary_claims(attached: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, faults) that make the ``chosen`` assets (entity_type, entity_id, category, asset_id) primary: of their entity and category the chosen one says so and those that did say
    so no longer do; what is as it should be is not said again. ``attached`` has is_primary. A fault is a chosen asset that isn't attached there; of several
    for one category the least asset is taken."""
    group = ["entity_type", "entity_id", "category"]
    wanted = chosen.select(*group, "asset_id").distinct().withColumn("_wanted", F.lit(True))
    least = F.min(F.when(F.col("_wanted"), F.col("asset_id"))).over(W.partitionBy(*group))
    rows = attached.join(wanted, [*group, "asset_id"], "left").withColumn("_new", F.col("asset_id") == least).drop("_wanted").filter(F.col("_new") != F.coalesce("is_primary", F.lit(False)))
    rows = stored(rows, "primary")  # the categories are asked for before the claims are made
    known = [r.category for r in rows.select("category").distinct().collect()]  # categories are a handful of words
    claims, _ = media_claims(rows.withColumn("is_primary", F.col("_new")), known)
    faults = chosen.join(attached, [*group, "asset_id"], "left_anti").select(*group, "asset_id", F.lit("not attached").alias("fault"))
    return claims, faults


def input_faults(given: DataFrame, row: str, value: str, vocabulary: DataFrame, by: str) -> DataFrame:
    """Lists given by hand: (row, value, fault) for values given twice, in whatever case, and values that the vocabulary lacks."""
    said = given.select(F.col(row).alias("_row"), F.lower(F.trim(value)).alias("_value"))
    twice = said.groupBy("_row", "_value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row", "_value", F.lit("given twice").alias("fault"))
    unknown = said.distinct().join(vocabulary.select(F.lower(by).alias("_value")).distinct(), "_value", "left_anti").select("_row", "_value", F.lit("unknown").alias("fault"))
    return twice.unionByName(unknown).select(F.col("_row").alias(row), F.col("_value").alias(value), "fault")


def joint_changeset(claims: DataFrame, changeset_id: int, citation: str | None = None) -> DataFrame:
    """Claims of several entities under one changeset, each with a copy of the citation where it has none of its own."""
    own = F.col("citation") if "citation" in claims.columns else F.lit(None)
    return claims.withColumns({"changeset_id": F.lit(changeset_id).cast("bigint"), "citation": F.coalesce(own.cast("string"), F.lit(citation).cast("string"))})


def metadata(spark, entities: list[EntitySpec], media_categories: dict[str, list[str]]) -> DataFrame:
    """(entity, field, type, categories) of the registry, for clients."""
    rows = [(e.name, f.name, f.type, media_categories.get(e.name, [])) for e in entities for f in e.fields]
    return spark.createDataFrame(rows, "entity string, field string, type string, categories array<string>")
