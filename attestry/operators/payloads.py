"""Cached payloads: an index from each payload to the entities that it was made from tells which are stale after a change; age does the rest.

Payloads have payload_id, payload, etag and made_at; the index (``parts``) has payload_id, entity_type and entity_id, one row for each entity a payload was made from.
A change has entity_type, entity_id and at; entity_type ``*`` is a change that everything hangs on, such as a policy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Changes of this type hit every payload.
ALL = "*"
COLUMNS = ["payload_id", "payload", "etag", "made_at"]


def stale(payloads: DataFrame, parts: DataFrame, changes: DataFrame, now: Column, seconds: int) -> DataFrame:
    """(payload_id, reason) of payloads that are ``changed`` (something they were made from changed after they were made) or ``expired`` (at least as old
    as ``seconds``). The latest change of each entity is enough, so a hot entity is one row before it meets the index."""
    last = changes.filter(F.col("entity_type") != ALL).groupBy("entity_type", "entity_id").agg(F.max("at").alias("_at"))
    hit = parts.join(last, ["entity_type", "entity_id"]).groupBy("payload_id").agg(F.max("_at").alias("_at"))
    whole = changes.filter(F.col("entity_type") == ALL).agg(F.max("at").alias("_all"))
    rows = payloads.select("payload_id", "made_at").join(hit, "payload_id", "left").withColumn("_all", whole.select("_all").scalar())
    changed = F.coalesce(F.greatest("_at", "_all") > F.col("made_at"), F.lit(False))
    expired = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("made_at").cast("timestamp")) >= F.lit(seconds * 1_000_000)
    reason = F.when(changed, "changed").when(expired, "expired")
    return rows.select("payload_id", reason.alias("reason")).filter("reason IS NOT NULL")


Made = tuple[DataFrame, DataFrame]


def refreshed(payloads: DataFrame, parts: DataFrame, gone: DataFrame, wanted: DataFrame, make: Callable[[DataFrame], Made], now: Column) -> Made:
    """(payloads, parts) after those in ``gone`` (payload_id) and those that ``wanted`` (payload_id) has and the cache lacks were made anew. ``make`` gets the ids and
    gives (payload_id, payload) and the index rows of them. What is made of equal content keeps its etag, as that follows the content; ids that are not wanted
    any more are dropped."""
    kept = payloads.join(gone.select("payload_id"), "payload_id", "left_anti").join(wanted, "payload_id", "left_semi")
    missing = wanted.join(kept.select("payload_id"), "payload_id", "left_anti")
    fresh, index = make(missing)
    fresh = fresh.select("payload_id", "payload", F.md5("payload").alias("etag"), now.alias("made_at"))
    same = parts.join(kept.select("payload_id"), "payload_id", "left_semi")
    return kept.select(*COLUMNS).unionByName(fresh), same.unionByName(index.select(*parts.columns))
