"""History: previous values, winner flags, the change feed, contributions, cited changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ENTITY_KEY = ("entity_type", "entity_id", "claim_key")


def with_previous(claims: DataFrame, same_author: bool = False) -> DataFrame:
    """Adds previous: the value before, of the same key (and author)."""
    keys = [*ENTITY_KEY, *(["user_id"] if same_author else [])]
    return claims.withColumn("previous", F.lag("value").over(W.partitionBy(*keys).orderBy("created_at", "claim_id")))


def changes(claims: DataFrame) -> DataFrame:
    """One row a changeset and entity with its changes (field, old, new, active), newest claim first within."""
    rows = with_previous(claims)
    one = F.struct(F.col("created_at"), F.col("claim_id"), F.col("field_name"), F.col("previous").alias("old"), F.col("value").alias("new"), F.col("is_active"))
    g = rows.groupBy("changeset_id", "entity_type", "entity_id").agg(F.max("created_at").alias("at"), F.sort_array(F.collect_list(one), asc=False).alias("changes"))
    return g.withColumn("changes", F.transform("changes", lambda x: x.dropFields("created_at", "claim_id")))


def retractions(claims: DataFrame) -> DataFrame:
    return claims.filter("retracted_by_changeset_id IS NOT NULL").select(F.col("retracted_by_changeset_id").alias("changeset_id"), *ENTITY_KEY, "value")


def feed(changesets: DataFrame, claims: DataFrame, names: DataFrame, entity_type: str | None = None, since=None, until=None) -> DataFrame:
    """Changesets with their number of claims and the name of their entity; filters by type and (inclusive) time."""
    rows = claims.filter(F.col("entity_type") == entity_type) if entity_type else claims
    g = rows.groupBy("changeset_id", "entity_type", "entity_id").agg(F.count(F.lit(1)).alias("claims"))
    out = changesets.join(g, "changeset_id").join(names, ["entity_type", "entity_id"], "left")
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("created_at") <= F.lit(until))
    return out


def contributions(changes_: DataFrame, user: str, kind: str, unit: str, at: str) -> DataFrame:
    """For each user and kind the number of distinct units and the last time, most first."""
    g = changes_.groupBy(user, kind).agg(F.countDistinct(unit).alias("units"), F.max(at).alias("last_at"))
    return g.orderBy(F.desc("units"), user, kind)


def cited(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """For each changeset its cited fields and its distinct citations (source, locator), both sorted."""
    rows = claims.join(citations, "claim_id")
    return rows.groupBy("changeset_id").agg(F.sort_array(F.collect_set("field_name")).alias("fields"), F.sort_array(F.collect_set(F.struct("citation_source_id", "locator"))).alias("citations"))


def names_of(**tables: DataFrame) -> DataFrame:
    """One table of entity names from one a type (entity_id, name)."""
    parts = [t.select(F.lit(kind).alias("entity_type"), F.col("entity_id").cast("bigint").alias("entity_id"), "name") for kind, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
