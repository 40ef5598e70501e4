"""Mixing sources to target weights by hash-random order, distributed prefix sums and exact cuts, in DataFrame functions only.

Each source gets a target of words: the sources, in code point order with null last, share ``share`` times all words by
``weights`` (repeating), no target above ``cap`` times its source's words, what is cut off shared again by weight. Within a source
documents stand in the order of md5(seed, doc_id) and a hash of their text (without an id, of md5(seed, that hash)); running sums over that order are made in two
levels (sums of hash ranges, then rows within a range), so that a hot source is spread over many tasks. The mix takes whole
epochs of a source and then documents from the front until the target's exact word, the last one in part.

Defined cases: null text has no words; null source is a source; equal rows are ordered as one row and repeated (each gets its own
cut); a source without words gets target 0; an empty table gives an empty result. No order depends on partitions: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._spark import stage
from .quality_rules import SEP


def sizes(docs: DataFrame, text: str, key: str, source: str, *carried: Column) -> DataFrame:
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SEP), "")).cast("long")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words.alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("content"), *carried)


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, target. Water filling: sources are capped in the order of size over weight, as long
    as the level that the rest would get is above that; one row per source is all that these windows hold."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    of = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(of, (rank % len(weights)).cast("int")))
    most = cap * F.col("source_size")
    every = W.partitionBy()
    fill = W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("ratio", most / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(most).over(fill), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
    )
    # a source is capped as long as its ratio is not above the level left to it and the later ones; the first that is above sets the level
    per = per.withColumn("place", F.row_number().over(W.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())))
    above = F.col("ratio") > F.col("level")
    per = per.withColumn("water", F.min_by("level", F.when(above, F.col("place"))).over(every))
    return per.select("source", "source_size", F.when(F.col("water").isNull(), most).otherwise(F.least(most, F.col("water") * F.col("weight"))).alias("target"))


def keyed(sized: DataFrame, seed: str, ranges: int) -> DataFrame:
    """Adds order (hash-random) and range (its first bits, ``ranges`` of equal width)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("content").cast("string")))  # rows without id are spread by their texts
    order = F.md5(F.concat_ws(":", F.lit(seed), name))
    first = F.conv(F.substring("order", 1, 6), 16, 10).cast("long")
    return sized.withColumn("order", order).withColumn("range", F.floor(first * ranges / F.lit(1 << 24)).cast("int"))


def cuts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` (of :func:`keyed`) with before, taken and copies; ``parts`` has a row for each source and range."""
    within = W.partitionBy("source", "range").orderBy("order", "content").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["_s"]) & (rows["range"] == parts["_r"])).drop("_s", "_r")
    size, total = F.col("size"), F.col("source_size")
    rows = rows.withColumn("before", F.col("ahead") + F.col("inner"))
    rows = rows.withColumn("epochs", F.when(total > 0, F.floor(F.floor("target") / total)).otherwise(0))
    part = F.greatest(F.lit(0), F.least(size, F.floor("target") - F.col("epochs") * total - F.col("before")))
    copies = F.col("epochs") + F.when((size > 0) & (2 * part >= size), 1).otherwise(0)
    return rows.withColumn("taken", (F.col("epochs") * size + part).cast("long")).withColumn("copies", copies.cast("int"))


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: str, rows_per_range: int) -> tuple[DataFrame, int]:
    """The words ahead of each range of each source, with the source's size and target; and the number of ranges, which follows the
    rows, so that each range stays small whatever the input."""
    goal = targets(sized, weights, share, cap).select(F.col("source").alias("_g"), "source_size", "target")
    ranges = max(1, min(1 << 24, -(-sized.count() // rows_per_range)))
    ahead = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = keyed(sized, seed, ranges).groupBy("source", "range").agg(F.sum("size").alias("part"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0)))
    parts = parts.join(goal, parts["source"].eqNullSafe(goal["_g"]))
    return parts.select(F.col("source").alias("_s"), F.col("range").alias("_r"), "ahead", "source_size", "target"), ranges


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", text: str = "text", key: str = "doc_id", source: str = "source", rows_per_range: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, before (words of the source ahead of it in mix order),
    taken (words, repeats counted), copies (whole copies, see :func:`mix`)."""
    sized = stage(sizes(docs, text, key, source), "sizes")
    parts, ranges = plan(sized, weights, share, cap, seed, rows_per_range)
    return cuts(keyed(sized, seed, ranges), parts).select("doc_id", "source", "size", "source_size", "target", "before", "taken", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1", text: str = "text", key: str = "doc_id", source: str = "source", rows_per_range: int = 4000) -> DataFrame:
    """The mixed table, with the columns of ``docs``: a row for each copy. The document that a cut falls into is taken whole if at
    least half of it lies before the cut. Texts are shuffled once, with the order key."""
    sized = stage(sizes(docs, text, key, source), "sizes")
    parts, ranges = plan(sized, weights, share, cap, seed, rows_per_range)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    chosen = cuts(keyed(sizes(docs, text, key, source, row), seed, ranges), parts).filter("copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
