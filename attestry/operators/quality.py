"""Data-quality checks: a registry of DataFrames of findings, their union and tallies, golden records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import stored
from .hierarchy import long_chains

FINDING = ("severity", "check", "subject", "detail")
Check = Callable[[dict[str, DataFrame]], DataFrame]
CHECKS: dict[str, Check] = {}


def finding(rows: DataFrame, severity: str, check: str, subject: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def check(name: str, severity: str):
    """Registers a function from tables to rows with subject and detail."""

    def register(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Check:
        CHECKS[name] = lambda tables: finding(f(tables), severity, name, F.col("subject"), F.col("detail"))
        return CHECKS[name]

    return register


def nameless(rows: DataFrame, id_: str, name: str) -> DataFrame:
    return rows.filter(F.col(name).isNull() | (F.trim(name) == "")).select(F.col(id_).alias("subject"), F.lit("no name").alias("detail"))


def self_references(rows: DataFrame, id_: str, parent: str) -> DataFrame:
    return rows.filter(F.col(id_) == F.col(parent)).select(F.col(id_).alias("subject"), F.lit("is its own parent").alias("detail"))


def dangling(rows: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is set and leads nowhere."""
    t = targets.select(F.col(target_key).alias("_t")).distinct()
    return rows.filter(F.col(key).isNotNull()).join(t, F.col(key) == F.col("_t"), "left_anti").select(F.col(key).alias("subject"), F.lit("no such entity").alias("detail"))


def same_names(rows: DataFrame, name: str) -> DataFrame:
    g = rows.groupBy(F.lower(name).alias("subject")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.select("subject", F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def unset(rows: DataFrame, id_: str, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNull()).select(F.col(id_).alias("subject"), F.lit(f"no {column}").alias("detail"))


def flagged(rows: DataFrame, id_: str, flag: Column) -> DataFrame:
    return rows.filter(flag).select(F.col(id_).alias("subject"), F.lit("needs review").alias("detail"))


def childless(rows: DataFrame, id_: str, children: DataFrame, parent: str) -> DataFrame:
    """Rows that nothing belongs to."""
    return rows.join(children.select(F.col(parent).alias("_c")), F.col(id_) == F.col("_c"), "left_anti").select(F.col(id_).alias("subject"), F.lit("has no rows").alias("detail"))


def chained(rows: DataFrame, id_: str, parent: str) -> DataFrame:
    """Variants of variants: one hop is all a chain may have."""
    return long_chains(rows, id_, parent).select(F.col(id_).alias("subject"), F.concat(F.lit("variant of variant "), F.col(parent).cast("string")).alias("detail"))


def orphaned(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that active claims speak of and that are not there, each once. ``entities`` has entity_type and entity_id."""
    keys = ["entity_type", "entity_id"]
    gone = claims.filter("is_active").select(*keys).distinct().join(entities.select(*keys), keys, "left_anti")
    return gone.select(F.col("entity_id").alias("subject"), F.concat(F.lit("claims about a missing "), F.col("entity_type")).alias("detail"))


def unresolved(won: DataFrame, field: str, target: Column, targets: DataFrame, key: str) -> DataFrame:
    """Targets that winning claims of a field name and that are not there, each once; ``target`` is made of the column ``value``: the claim's value for a foreign
    key, a key of its JSON for a relationship. It is made once a value, as many claims say the same."""
    said = (F.col("claim_key") == field) | F.col("claim_key").startswith(f"{field}|")
    # stored, as what is asked of the subject would else be asked of every claim
    values = stored(won.filter(said).select("value").distinct(), "values")
    named = values.select(target.alias("subject")).filter("subject IS NOT NULL AND trim(cast(subject AS string)) <> ''").distinct()
    missing = named.join(targets.select(F.col(key).alias("_t")), F.col("subject") == F.col("_t"), "left_anti")
    return missing.select("subject", F.lit(f"no target for {field}").alias("detail"))


def unclaimed(rows: DataFrame, keys: list[str], claims: DataFrame) -> DataFrame:
    """Materialized rows that no active claim stands for any more."""
    left = rows.select(*keys).distinct().join(claims.select(*keys), keys, "left_anti")
    return left.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("subject"), F.lit("no active claim").alias("detail"))


def uncurated(rows: DataFrame, id_: str, claims: DataFrame, source_id: int, field: str) -> DataFrame:
    """Entities for which the curating source has no active claim of the field: they came with somebody else's data."""
    by = claims.filter(F.col("is_active") & (F.col("source_id") == source_id) & (F.col("field_name") == field)).select(F.col("entity_id").alias("_e"))
    return rows.join(by, F.col(id_) == F.col("_e"), "left_anti").select(F.col(id_).alias("subject"), F.lit(f"no curated {field}").alias("detail"))


def golden(rows: DataFrame, key: str, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Expected (key, field, value) against rows: missing rows and fields that differ."""
    have = rows.select(F.col(key).alias("_key"), *[F.col(f).cast("string").alias(f) for f in fields]).unpivot("_key", fields, "_field", "_value")
    both = expected.join(have, (F.col(key) == F.col("_key")) & (F.col("field") == F.col("_field")), "left")
    off = both.filter(~F.col("value").eqNullSafe(F.col("_value")))
    detail = F.when(F.col("_key").isNull(), "missing").otherwise(F.concat_ws(" ", F.col("field"), F.lit("is"), F.coalesce("_value", F.lit("null")), F.lit("not"), F.col("value")))
    return off.select(F.col(key).alias("subject"), detail.alias("detail"))


def findings(tables: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [CHECKS[n](tables) for n in names or CHECKS])


def tallies(found: DataFrame, examples: int = 5) -> DataFrame:
    """Findings by check: how many, and the first few subjects."""
    counts = found.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n"))
    # first the least subjects of each part of a check, then the least of these: no task holds all subjects of a check
    parts = found.select("severity", "check", "subject").distinct().withColumn("_part", F.pmod(F.xxhash64("subject"), F.lit(64)))
    part = W.partitionBy("severity", "check", "_part").orderBy("subject")
    least = parts.withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= examples)
    shown = least.groupBy("severity", "check").agg(F.slice(F.sort_array(F.collect_list("subject")), 1, examples).alias("examples"))
    return counts.join(shown, ["severity", "check"], "left").orderBy(F.desc("n"), "check")
