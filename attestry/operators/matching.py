"""Matching of outside records to entities: cascades of keys, keys that count only if unique, near duplicates, dictionaries in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, targets: DataFrame, keys: list[tuple[str, Column, Column]], target_id: str) -> DataFrame:
    """Adds target_id and match_type: the first of the named keys (key of rows, key of targets) by which a target is found.

    A key that several targets have gives the smallest id; null keys match nothing."""
    found, kind = None, None
    for i, (name, left, right) in enumerate(keys):
        t = targets.select(right.alias(f"_k{i}"), F.col(target_id).alias(f"_t{i}")).filter(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min(f"_t{i}").alias(f"_t{i}"))
        rows = rows.withColumn(f"_l{i}", left).join(t, F.col(f"_l{i}") == F.col(f"_k{i}"), "left").drop(f"_l{i}", f"_k{i}")
        hit = F.col(f"_t{i}")
        found = hit if found is None else F.coalesce(found, hit)
        kind = F.when(hit.isNotNull(), name) if kind is None else kind.when(hit.isNotNull(), name)
    out = rows.withColumns({target_id: found, "match_type": kind})
    return out.drop(*[f"_t{i}" for i in range(len(keys))])


def unique_keys(rows: DataFrame, key: Column, value: str, by_row: bool = True) -> DataFrame:
    """Keys that lead to one place: one row (``by_row``), or rows that all say the same value."""
    g = rows.select(key.alias("key"), F.col(value).alias("value")).groupBy("key")
    g = g.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("value").alias("values"), F.min("value").alias(value))
    return g.filter("rows = 1" if by_row else "values = 1").select("key", value)


def aliases(names: DataFrame, key: Column, value: str, policy: str = "first", order: str = "seq") -> DataFrame:
    """Key to value where aliases collide: the first, the last, or none of them (skip)."""
    g = names.select(key.alias("key"), F.col(value), F.col(order)).groupBy("key")
    if policy == "skip":
        return g.agg(F.countDistinct(value).alias("n"), F.min(value).alias(value)).filter("n = 1").drop("n")
    pick = F.min_by if policy == "first" else F.max_by
    return g.agg(pick(value, order).alias(value))


def near_duplicates(people: DataFrame, works: DataFrame, id_: str, name: Column, work: str) -> DataFrame:
    """Pairs of persons with the same last word of the name and a common work: an equality join on (work, last word)."""
    from ..functions.names import last_name

    rows = people.select(F.col(id_), last_name(name).alias("_last")).join(works.select(id_, work).distinct(), id_)
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col(f"a.{work}") == F.col(f"b.{work}")) & (F.col("a._last") == F.col("b._last")) & (F.col(f"a.{id_}") < F.col(f"b.{id_}"))
    return a.join(b, same).select(F.col(f"a.{id_}").alias("left_id"), F.col(f"b.{id_}").alias("right_id")).distinct()


def dictionary_matches(texts: DataFrame, text: str, terms: DataFrame, term: str, most_terms: int = 10_000) -> DataFrame:
    """(row of texts, term) for terms of words that stand in the text, whatever the case.

    Instead of trying every term on every text, the word n-grams of a text (of the lengths that terms have) are joined to the terms.
    Up to ``most_terms`` terms (counted first), n-grams that are no term are dropped before a row is spread over its n-grams."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    vocabulary = terms.select(F.col(term), F.array_join(F.filter(F.split(F.lower(F.col(term)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ").alias("_key")).filter("_key <> ''")
    lengths = [r[0] for r in vocabulary.select(F.size(F.split("_key", " ")).alias("n")).distinct().collect()]

    def grams_of(n: int) -> Column:
        if n == 1:
            return F.col("_w")
        grams = F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))
        return F.when(F.size("_w") >= n, grams).otherwise(F.array().cast("array<string>"))

    grams = [grams_of(n) for n in sorted(lengths)]
    if not grams:
        return texts.limit(0).join(terms.limit(0), F.lit(True), "inner")
    found = F.array_distinct(F.flatten(F.array(*grams)))
    known = [r[0] for r in vocabulary.select("_key").distinct().limit(most_terms + 1).collect()]
    if len(known) <= most_terms:
        found = F.array_intersect(F.flatten(F.array(*grams)), F.lit(known))
    rows = texts.withColumn("_w", words).withColumn("_key", F.explode(found)).drop("_w")
    return rows.join(vocabulary, "_key").drop("_key")


def place_of(rows: DataFrame, places: DataFrame, city: str, state: str, country: str) -> DataFrame:
    """Adds location_path: the city below its state, else below its country (state unknown), else anywhere in the country if only one is named so.

    ``places`` has location_path and name; paths are country/state/city or country/city."""
    p = places.select("location_path", F.lower("name").alias("_name"), F.regexp_replace("location_path", "/?[^/]*$", "").alias("_parent"), F.substring_index("location_path", "/", 1).alias("_root"))
    roots = p.filter("_parent = ''").select(F.col("_name").alias("_cn"), F.col("location_path").alias("_country"))
    out = rows.join(roots, F.lower(F.col(country)) == F.col("_cn"), "left").drop("_cn")
    states = p.filter("_parent <> ''").select(F.col("_name").alias("_sn"), F.col("_parent").alias("_sp"), F.col("location_path").alias("_state"))
    out = out.join(states, (F.lower(F.col(state)) == F.col("_sn")) & (F.col("_country") == F.col("_sp")), "left").drop("_sn", "_sp")
    towns = p.select(F.col("_name").alias("_tn"), F.col("_parent").alias("_tp"), F.col("location_path").alias("_town"))
    out = out.join(towns, (F.lower(F.col(city)) == F.col("_tn")) & (F.coalesce("_state", "_country") == F.col("_tp")), "left").drop("_tn", "_tp")
    anywhere = p.filter("_parent <> ''").groupBy(F.col("_name").alias("_an"), F.col("_root").alias("_ar")).agg(F.min("location_path").alias("_any"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    out = out.join(anywhere, (F.lower(F.col(city)) == F.col("_an")) & (F.col("_country") == F.col("_ar")), "left").drop("_an", "_ar")
    named = F.col(city) != ""
    return out.withColumn("location_path", F.when(named, F.coalesce("_town", "_any")).otherwise(F.coalesce("_state", "_country"))).drop("_country", "_state", "_town", "_any")


def ranked(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``name``: place from 1 within each group, without one task for a large group: numbers over all rows, less the first one of the group."""
    from .claims import numbered

    placed = numbered(rows, [by, *order])
    first = placed.groupBy(F.col(by).alias("_by")).agg(F.min("number").alias("_from"))
    return placed.join(first, F.col(by) == F.col("_by")).withColumn(name, F.col("number") - F.col("_from") + 1).drop("number", "_by", "_from")


def unique_slugs(rows: DataFrame, base: str, order: str, taken: DataFrame) -> DataFrame:
    """Adds slug: the base, or base-2, base-3, ... where it is taken or given out before. ``taken`` has slug; bases are not null.

    The r-th row of a base gets the r-th free number. With the used numbers of a base in order, the i-th of them, u, has u - i free ones below it; rows and used numbers are
    sorted together by r and u - i (a row first), and the place of a row among them is its number. No group is gathered, however many rows a base has."""
    used = taken.select(F.regexp_replace("slug", "-[0-9]+$", "").alias("_b"), "slug").unionByName(taken.select(F.col("slug").alias("_b"), "slug")).distinct()
    number = F.when(F.col("slug") == F.col("_b"), 1).otherwise(F.regexp_extract(F.col("slug"), "-([0-9]+)$", 1).try_cast("int"))
    used = used.withColumn("_u", number).filter("_u >= 1").select("_b", "_u").distinct().join(rows.select(F.col(base).alias("_b")).distinct(), "_b", "left_semi")
    below = ranked(used, "_b", ["_u"], "_i").select("_b", (F.col("_u") - F.col("_i")).alias("_k"), F.lit(1).alias("_used"), F.lit(None).cast("bigint").alias("_row"))
    placed = ranked(rows.withColumn("_id", F.monotonically_increasing_id()), base, [order, "_id"], "_r")
    asking = placed.select(F.col(base).alias("_b"), F.col("_r").alias("_k"), F.lit(0).alias("_used"), F.col("_r").alias("_row"))
    free = ranked(asking.unionByName(below), "_b", ["_k", "_used"], "_free").filter("_used = 0").select("_b", "_row", "_free")
    out = placed.join(free, (F.col(base) == F.col("_b")) & (F.col("_r") == F.col("_row")))
    slug = F.when(F.col("_free") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.col("_free").cast("string")))
    return out.withColumn("slug", slug).drop("_id", "_r", "_b", "_row", "_free")
