"""Sets of rows as bitmaps: members are numbered densely once, a set is a row of bits for each bucket of 32,768 numbers, and unions, intersections and counts
are aggregates over those rows, combined before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import numbered


def positions(rows: DataFrame, member: str) -> DataFrame:
    """(member, number): distinct members, not null, numbered from 1."""
    return numbered(rows.select(F.col(member).alias("member")).filter("member IS NOT NULL").distinct(), ["member"])


def sets(rows: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """(by, bucket, bits): the numbers of each group. Repeated numbers are one bit, so nothing has to be made distinct."""
    placed = rows.select(*by, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"))
    return placed.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def union(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersection(bitmaps: DataFrame, by: list[str], of: int, label: str = "label") -> DataFrame:
    """What the ``of`` sets named by ``label`` share (one row a set and bucket); buckets that one of them lacks are empty."""
    both = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(label).alias("_n"))
    return both.filter(F.col("_n") == of).drop("_n")


def sizes(bitmaps: DataFrame, by: list[str], name: str = "members") -> DataFrame:
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))
