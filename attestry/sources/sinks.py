"""Sinks for plain Parquet: snapshots, upserts, tagged payloads, run records."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` after ``rows`` (one a key): columns of rows replace, others stay; adds status: created, updated or unchanged."""
    values = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_in"))
    both = table.withColumn("_had", F.lit(True)).join(new, keys, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_new.{v}"))
    status = F.when(F.col("_had").isNull(), "created").when(F.col("_in").isNull() | same, "unchanged").otherwise("updated")
    out = [c if c in keys else F.when(F.col("_in").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else c for c in table.columns]
    return both.select(*out, status.alias("status"))


def add_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet are added; the others are ignored."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def tagged(rows: DataFrame) -> DataFrame:
    """Rows as JSON payloads with a tag that changes with the content."""
    payload = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    return rows.select("*", payload.alias("payload"), F.md5(payload).alias("etag"))


def snapshot(rows: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a new snapshot folder and return it; readers of older ones are not disturbed."""
    path = f"{root.rstrip('/')}/snapshot-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    w = rows.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def recorded(spark: SparkSession, path: str, name: str, run: Callable[[], dict[str, int]]) -> dict[str, int]:
    """Run and append a record of it (status, counts, error), also if it fails."""
    began, status, counts, error = datetime.now(timezone.utc), "failed", {}, None
    try:
        counts = run()
        status = "done"
        return counts
    except Exception as e:
        error = str(e)[:500]
        raise
    finally:
        row = [(name, began, datetime.now(timezone.utc), status, {k: int(v) for k, v in counts.items()}, error)]
        spark.createDataFrame(row, "name string, began timestamp, ended timestamp, status string, counts map<string,bigint>, error string").write.mode("append").parquet(path)
