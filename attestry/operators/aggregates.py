"""Aggregates of the serving queries: agreement, intersections, first and newest rows, conditional counts, ordered collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def active(status: Column) -> Column:
    """Rows in use: status active or not given."""
    return (status == "active") | status.isNull()


def agreed(value: Column) -> Column:
    """The value if every row of the group has it, else null."""
    return F.when((F.count(value) == F.count(F.lit(1))) & (F.min(value) == F.max(value)), F.min(value))


def first_by(value: Column, *order: Column) -> Column:
    """Value of the row that is first in the order (struct comparison, nulls of order columns first)."""
    return F.min_by(value, F.struct(*order))


def last_by(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.struct(*order))


def first_row(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a group, by a window where the order has null placements that structs can't say."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def counted(parents: DataFrame, children: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Parents with a count of children for each condition; parents without children count 0."""
    c = children.groupBy(key).agg(*[F.count_if(cond).alias(n) for n, cond in conditions.items()])
    return parents.join(c, key, "left").fillna(0, list(conditions))


def _by_member(rows: DataFrame, group: str, member: str, parts: int | None) -> DataFrame:
    """Rows dealt by group and a share (``_share``) of its members, so that a task has whole members and no large group alone."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_share", F.pmod(F.xxhash64(member), F.lit(64)).cast("int")).repartition(n, group, "_share")


def shared_by_all(rows: DataFrame, group: str, member: str, *values: str, parts: int | None = None) -> DataFrame:
    """Values that every member of a group has (members without any make it empty): counts instead of pairwise intersection. Rows are dealt over ``parts``
    partitions (:func:`parts_for`), by default as many as a shuffle has."""
    return _shared(rows, group, member, values, None, parts)


def shared_with_payload(rows: DataFrame, group: str, member: str, value: str, payload: str, parts: int | None = None) -> DataFrame:
    """As :func:`shared_by_all`, with the payload if all members agree on it."""
    return _shared(rows, group, member, (value,), payload, parts)


def _shared(rows: DataFrame, group: str, member: str, values: tuple[str, ...], payload: str | None, parts: int | None) -> DataFrame:
    """Rows are read once: each also counts for its group as a whole (``_all``), which gives the number of members. Shares of a group are counted first, then
    added: no member is in two shares."""
    kinds = {f.name: f.dataType for f in rows.schema}
    said = F.struct(F.lit(False).alias("_all"), *values)
    whole = F.struct(F.lit(True).alias("_all"), *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    more = [payload] if payload else []
    dealt = _by_member(rows.filter(F.col(group).isNotNull()).select(group, member, *values, *more), group, member, parts)
    each = dealt.select(group, "_share", member, *more, F.inline(F.array(said, whole)))
    keys = [group, "_all", *values]
    first = [F.countDistinct(member).alias("_n")]
    then = [F.sum("_n").alias("_n")]
    if payload:
        first += [F.count(payload).alias("_told"), F.count(F.lit(1)).alias("_rows"), F.min(payload).alias("_least"), F.max(payload).alias("_most")]
        then += [F.sum("_told").alias("_told"), F.sum("_rows").alias("_rows"), F.min("_least").alias("_least"), F.max("_most").alias("_most")]
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = each.groupBy("_share", *keys).agg(*first).repartition(n, group).groupBy(*keys).agg(*then)
    size = F.max(F.when(F.col("_all"), F.col("_n"))).over(W.partitionBy(group))
    found = counts.withColumn("_size", size).filter(~F.col("_all") & F.col(values[0]).isNotNull() & (F.col("_n") == F.col("_size")))
    same = [F.when((F.col("_told") == F.col("_rows")) & (F.col("_least") == F.col("_most")), F.col("_least")).alias(payload)] if payload else []
    return found.select(group, *values, *same)


def identical_sets(rows: DataFrame, group: str, member: str, value: str, parts: int | None = None) -> DataFrame:
    """Groups whose members all have the same non-empty set, with it (sorted)."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _by_member(rows.select(group, member, value), group, member, parts).groupBy(group, "_share", member).agg(F.sort_array(F.collect_set(value)).alias("s"))
    ends = sets.groupBy(group, "_share").agg(F.min("s").alias("a"), F.max("s").alias("z")).repartition(n, group).groupBy(group).agg(F.min("a").alias("a"), F.max("z").alias("z"))
    return ends.filter("a = z AND size(a) > 0").select(group, F.col("a").alias("values"))


def ordered_structs(order: Column, *fields: Column) -> Column:
    """Distinct structs in order of their first place."""
    got = F.sort_array(F.collect_list(F.struct(order.alias("_o"), F.struct(*fields).alias("v"))))
    return F.array_distinct(F.transform(got, lambda x: x["v"]))


def repeated_names(rows: DataFrame, name: str, id_: str) -> DataFrame:
    """Names that more than one row has, whatever the case."""
    return rows.groupBy(F.lower(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(id_)).alias("ids")).filter("n > 1")


def top_per_group(rows: DataFrame, order: list[Column], scanned: int, group: str, most: int) -> DataFrame:
    """Of the first ``scanned`` rows one a group, the first ``most``: a top-k report, so that few rows may come."""
    head = rows.orderBy(*order).limit(scanned)
    w = W.partitionBy(group).orderBy(*order)
    return head.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(*order).limit(most)


def field_agreement(claims: DataFrame) -> DataFrame:
    """For each entity and key whether its sources are single, agreed or in conflict."""
    g = claims.groupBy("entity_type", "entity_id", "claim_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("different"))
    return g.withColumn("state", F.when(F.col("different") > 1, "conflict").when(F.col("n") > 1, "agreed").otherwise("single"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of rows in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(rows: DataFrame, at: Column, id_: Column, cursor: tuple | None, size: int = 50) -> DataFrame:
    """The rows behind a cursor (time, id) in descending order, one more than asked for, so that the caller sees whether there are more."""
    if cursor is not None:
        t, i = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.filter((at <= t) & ((at < t) | (id_ < i)))
    return rows.orderBy(at.desc(), id_.desc()).limit(size + 1)


def by_ids(rows: DataFrame, key: str, ids: list[int], most: int = 50) -> DataFrame:
    """Rows of a short list of ids, with their place in it, in that order; ids that aren't there are left out, repeated ones count once. A list of
    more than ``most`` ids is refused."""
    known = rows.select(key)
    wanted = list(dict.fromkeys(ids))
    if len(wanted) > most:
        raise ValueError(f"{len(wanted)} ids, at most {most}")
    spark = rows.sparkSession
    listed = spark.createDataFrame([(i, n) for n, i in enumerate(wanted)], f"{key} {known.schema[key].dataType.simpleString()}, _n int")
    found = rows.join(F.broadcast(listed), key)
    return found.withColumn("place", F.row_number().over(W.orderBy("_n"))).drop("_n").orderBy("place")  # at most ``most`` rows


def labelled(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables of the same columns, with where they are from."""
    return reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(origin).alias("origin"), "*") for origin, t in tables.items()])
