"""Rules of lists that pages show: places within a group, first appearances, who is named alike, what stands for what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def placed(rows: DataFrame, by: list[str], *order: Column, name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in an order within each group."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def by_size(rows: DataFrame, by: list[str], size: str, label: str) -> DataFrame:
    """Children of a node: the largest first, then by name."""
    return placed(rows, by, F.desc(size), F.asc(label))


def by_year(rows: DataFrame, by: list[str], year: str, id_: str) -> DataFrame:
    """The newest first, unknown years last."""
    return placed(rows, by, F.desc_nulls_last(year), F.asc(id_))


def newest(rows: DataFrame, at: str, id_: str, most: int) -> DataFrame:
    """The ``most`` latest rows: a report of fixed length."""
    return rows.orderBy(F.desc(at), F.desc(id_)).limit(most)


def numbered_by_appearance(rows: DataFrame, list_: str, item: str, *order: str) -> DataFrame:
    """(list, item, place): each distinct item numbered by where it first stands in its list. Items are reduced to their first row before they are numbered."""
    first = rows.groupBy(list_, item).agg(F.min(F.struct(*order)).alias("_first"))
    return placed(first, [list_], F.col("_first")).select(list_, item, "place")


def touching(changes: DataFrame, members: DataFrame, entity: str, group: str, changeset: str) -> DataFrame:
    """(group, changesets): the distinct changesets that touch any entity of a group."""
    rows = changes.select(entity, changeset).join(members.select(entity, group), entity)
    return rows.groupBy(group).agg(F.countDistinct(changeset).alias("changesets"))


def alias_states(aliases: DataFrame, parent: str, parents: DataFrame, key: str, counterpart: str, known: DataFrame, known_key: str) -> DataFrame:
    """Aliases with ``state``: fail (no parent is named), orphan (there is no such parent), unmatched (the parent's counterpart is not known), ok."""
    up = parents.groupBy(F.col(key).alias("_key")).agg(F.min(counterpart).alias("_counterpart"), F.lit(True).alias("_there"))
    have = known.select(F.col(known_key).alias("_known")).distinct()
    rows = aliases.join(up, F.col(parent) == F.col("_key"), "left").join(have, F.col("_counterpart") == F.col("_known"), "left")
    state = F.when(F.col(parent).isNull(), "fail").when(F.col("_there").isNull(), "orphan").when(F.col("_known").isNull(), "unmatched").otherwise("ok")
    return rows.withColumn("state", state).drop("_key", "_counterpart", "_there", "_known")


def name_confidence(left: DataFrame, right: DataFrame, left_name: Column, right_name: Column, supported: DataFrame, key: str, high: float = 0.95, low: float = 0.85) -> DataFrame:
    """Rows of both sides whose names are alike whatever their case, with how far to trust it: more where ``supported`` (key) has something else that speaks for the left one."""
    a, b = left.withColumn("_name", F.lower(left_name)), right.withColumn("_name", F.lower(right_name))
    more = supported.select(key).distinct().withColumn("_more", F.lit(True))
    both = a.join(b, "_name").join(more, key, "left")
    return both.withColumn("confidence", F.when(F.col("_more"), high).otherwise(low)).drop("_name", "_more")


def only_base(rows: DataFrame, group: str, variant: Column) -> DataFrame:
    """Adds ``only_base``: no variant, the only one of its group that is none, and the group has no variants. Counts of groups are joined, so that a large
    group needn't be in one task."""
    marked = rows.withColumn("_variant", variant)
    sizes = marked.groupBy(F.col(group).alias("_g")).agg(F.count_if(~F.col("_variant")).alias("_bases"), F.count_if("_variant").alias("_variants"))
    both = marked.join(sizes, F.col(group) == F.col("_g"), "left")
    return both.withColumn("only_base", ~F.col("_variant") & (F.col("_bases") == 1) & (F.col("_variants") == 0)).drop("_variant", "_g", "_bases", "_variants")
