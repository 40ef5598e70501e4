"""Writes of places: paths and types are derived, not given; what is fixed when a place is made can't be changed later.

Places have location_path, slug, name, type, divisions (of countries only: what the levels below are called) and status. A place at the top is a country; below, the type is the
country's division for the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import unpivoted
from .hierarchy import depth, division

COUNTRY = "country"
#: fixed once a place is made
FIXED = ("slug", "parent", "type")


def creations(new: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places to make: seq, location_path, slug, name, parent, type, divisions; faults: seq, fault). New rows have seq, slug, name, parent (path, null at the top) and
    divisions (null but for countries). The first rule that a row breaks is its fault; of rows that would get one path the first keeps it."""
    active = F.coalesce("status", F.lit("active")) == "active"
    root = F.substring_index("parent", "/", 1)
    # one row a path, so that a path given twice doesn't multiply
    one = places.groupBy("location_path").agg(F.max(active.cast("int")).alias("_live"), F.max("divisions").alias("_div"))
    up = one.select(F.col("location_path").alias("_up"), (F.col("_live") == 1).alias("_up_live"))
    top = one.select(F.col("location_path").alias("_root"), F.col("_div").alias("_of"))
    rows = new.join(up, F.col("parent") == F.col("_up"), "left").join(top, root == F.col("_root"), "left")
    rows = rows.withColumn("location_path", F.when(F.col("parent").isNull(), F.col("slug")).otherwise(F.concat_ws("/", "parent", "slug")))
    kind = F.when(F.col("parent").isNull(), COUNTRY).otherwise(division(F.col("location_path"), F.col("_of")))
    first = rows.groupBy("location_path").agg(F.min("seq").alias("_first")).withColumnRenamed("location_path", "_path")
    taken = one.select(F.col("location_path").alias("_have")).withColumn("_taken", F.lit(True))
    rows = rows.withColumn("type", kind).join(taken, F.col("location_path") == F.col("_have"), "left").join(first, F.col("location_path") == F.col("_path"), "left")
    given = F.col("divisions").isNotNull()
    blank = F.exists(F.coalesce("divisions", F.array().cast("array<string>")), lambda d: d.isNull() | (F.trim(d) == ""))
    fault = (
        F.when(~F.coalesce(F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit(False)), "slug form")
        .when(F.coalesce(F.trim("name") == "", F.lit(True)), "no name")
        .when(F.col("parent").isNotNull() & F.col("_up").isNull(), "no such parent")
        .when(F.col("parent").isNotNull() & ~F.col("_up_live"), "parent is deleted")
        .when(F.col("parent").isNull() & (~given | (F.size("divisions") == 0)), "a country needs divisions")
        .when(F.col("parent").isNotNull() & given, "divisions are a country's")
        .when(blank, "blank division")
        .when(F.col("type").isNull(), "no division for this depth")
        .when(F.col("_taken"), "path taken")
        .when(F.col("_first") < F.col("seq"), "path given twice")
    )
    judged = rows.withColumn("fault", fault)
    good = judged.filter("fault IS NULL").select("seq", "location_path", "slug", "name", "parent", "type", F.transform("divisions", lambda d: F.trim(d)).alias("divisions"))
    return good, judged.filter("fault IS NOT NULL").select("seq", "fault")


def creation_claims(good: DataFrame, ids: DataFrame) -> DataFrame:
    """Scalar claims of the places to make; ``ids`` has location_path and entity_id."""
    rows = good.join(ids, "location_path").withColumn("divisions", F.to_json("divisions"))
    said = unpivoted(rows, "entity_id", ["slug", "name", "parent", "type", "divisions", "location_path"])
    return said.select(F.lit("location").alias("entity_type"), "entity_id", "field_name", F.col("field_name").alias("claim_key"), "value")


def patch_faults(changes: DataFrame, places: DataFrame) -> DataFrame:
    """(seq, fault) of changes (seq, location_path, field, value) that may not be made: of places that there are not or that are deleted, of what is fixed, of divisions below
    a country or without an entry, and blank names."""
    have = places.groupBy("location_path").agg(F.max((F.coalesce("status", F.lit("active")) == "active").cast("int")).alias("_live")).withColumnRenamed("location_path", "_path")
    rows = changes.join(have, F.col("location_path") == F.col("_path"), "left")
    listed = F.from_json("value", "array<string>")
    empty = listed.isNull() | (F.size(listed) == 0) | F.exists(listed, lambda d: d.isNull() | (F.trim(d) == ""))
    fault = (
        F.when(F.col("_path").isNull(), "no such place").when(F.col("_live") == 0, "place is deleted").when(F.col("field").isin(*FIXED), F.concat("field", F.lit(" is fixed")))
        .when((F.col("field") == "divisions") & (depth(F.col("location_path")) > 1), "divisions are a country's").when((F.col("field") == "divisions") & empty, "blank division")
        .when((F.col("field") == "name") & F.coalesce(F.trim("value") == "", F.lit(True)), "no name")
    )
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("seq", "fault")
