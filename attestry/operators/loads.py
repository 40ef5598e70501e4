"""Load phases: curated rows to upserts and claims. A phase is made of these steps; each says what was skipped and why.

Rows that a step can't use come back as warnings (reason, key); a step that must not lose any raises :class:`LoadError` with all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchy as Y
from .claims import first_write, relationship_claim


class LoadError(ValueError):
    """Rows that a phase can't do without are wrong; nothing was written."""


def refuse(offenders: DataFrame, what: str, shown: int = 50) -> None:
    """Raise if there are any, naming up to ``shown`` of them and how many there are."""
    keys = [str(r[0]) for r in offenders.select(offenders.columns[0]).distinct().orderBy(offenders.columns[0]).limit(shown + 1).collect()]
    if keys:
        more = f" and {offenders.distinct().count() - shown} more" if len(keys) > shown else ""
        raise LoadError(f"{what}: {', '.join(keys[:shown])}{more}")


def warnings(rows: DataFrame, reason: str, key: Column) -> DataFrame:
    return rows.select(F.lit(reason).alias("reason"), key.cast("string").alias("key"))


def with_parent(rows: DataFrame, parents: DataFrame, ref: str, by: str, id_: str, must: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with ``parent_id``, found by the parents' column ``by``; rows without reference keep null. Rows whose parent is missing are
    left out with a warning, or refused (``must``)."""
    dim = parents.select(F.col(by).alias("_by"), F.col(id_).alias("parent_id")).dropDuplicates(["_by"])
    both = rows.join(dim, F.col(ref) == F.col("_by"), "left")
    lost = both.filter(F.col(ref).isNotNull() & F.col("parent_id").isNull())
    if must:
        refuse(lost.select(ref), f"no such {ref}")
    return both.filter(F.col(ref).isNull() | F.col("parent_id").isNotNull()).drop("_by"), warnings(lost, f"missing {ref}", F.col(ref))


def tiers(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a path tree with tier (depth), parent path and whether that parent is among the rows: tiers are written from the top."""
    have = rows.select(F.col(path).alias("_have")).distinct()
    out = rows.withColumns({"tier": Y.depth(F.col(path)), "parent": Y.parent_path(F.col(path))})
    out = out.join(have, F.col("parent") == F.col("_have"), "left")
    return out.withColumn("parent_known", F.col("parent").isNull() | F.col("_have").isNotNull()).drop("_have")


def edges_of(rows: DataFrame, key: str, refs: str, vocabulary: DataFrame, by: str, must: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, target) for each reference in an array that ``vocabulary`` (by, key) has; others are warned of or refused."""
    said = rows.select(F.col(key).alias("_row"), F.explode(refs).alias("_ref")).distinct()
    both = said.join(vocabulary.select(F.col(by).alias("_ref"), F.col(key).alias("target")), "_ref", "left")
    lost = both.filter("target IS NULL")
    if must:
        refuse(lost.select("_ref"), f"unknown in {refs}")
    return both.filter("target IS NOT NULL").select(F.col("_row").alias(key), "target"), warnings(lost, f"unknown in {refs}", F.col("_ref"))


def alias_claims(rows: DataFrame, entity_type: str, id_: str, aliases: str, namespace: str = "alias") -> DataFrame:
    """A claim for each alias: keyed in lower case, with the spelling to show. Spellings of one alias give one claim, the least of them shown;
    blank ones none."""
    said = rows.select(F.col(id_).alias("entity_id"), F.explode(aliases).alias("_said")).withColumn("_shown", F.trim("_said")).filter("_shown <> ''")
    one = said.groupBy("entity_id", F.lower("_shown").alias("_key")).agg(F.min("_shown").alias("_shown"))
    key, value = relationship_claim(namespace, {"alias": F.col("_key")}, True, {"display": F.col("_shown")})
    return one.select(F.lit(entity_type).alias("entity_type"), "entity_id", F.lit(namespace).alias("field_name"), key.alias("claim_key"), value.alias("value"))


def membership_counts(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row: created and updated, by whether the key was there."""
    have = existing.select(F.col(key).alias("_have")).distinct()
    both = rows.select(key).distinct().join(have, F.col(key) == F.col("_have"), "left")
    return both.agg(F.count_if(F.col("_have").isNull()).alias("created"), F.count_if(F.col("_have").isNotNull()).alias("updated"))


def first_of_slug(rows: DataFrame, slug: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each slug, and warnings of the others."""
    kept = first_write(rows, order, (slug,))
    n = rows.groupBy(slug).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return kept, warnings(n, "repeated", F.col(slug))


def set_sync(desired: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Exact synchronisation of a set: add or remove for each member that only one side has."""
    new = desired.select(*keys, F.lit(1).alias("_d")).distinct()
    old = existing.select(*keys, F.lit(1).alias("_e")).distinct()
    both = new.join(old, keys, "full_outer").filter("_d IS NULL OR _e IS NULL")
    return both.select(*keys, F.when(F.col("_d").isNull(), "remove").otherwise("add").alias("action"))


def matched_titles(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (external_id, slug, name) to existing titles (title_id, external_id, slug): by external id, else by slug. outcome is create,
    update, rename, or conflict (the slug belongs to another title). Of several titles of an external id or slug, the one with the least id counts."""
    by_ext = existing.filter("external_id IS NOT NULL").groupBy("external_id").agg(F.min(F.struct("title_id", "slug")).alias("x")).select("external_id", F.col("x.title_id").alias("_ext"), F.col("x.slug").alias("_old"))
    by_slug = existing.groupBy("slug").agg(F.min("title_id").alias("_slug"))
    both = rows.join(by_ext, "external_id", "left").join(by_slug, "slug", "left")
    outcome = (
        F.when(F.col("_ext").isNull() & F.col("_slug").isNull(), "create").when(F.col("_ext").isNull(), "update").when(F.col("_old") == F.col("slug"), "update").when(F.col("_slug").isNotNull(), "conflict").otherwise("rename")
    )
    return both.select("external_id", "slug", F.coalesce("_ext", "_slug").alias("title_id"), outcome.alias("outcome"))


def vocabulary_check(rows: DataFrame, key: str, vocabularies: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All references that no vocabulary has: (field, value, rows). ``vocabularies``: array column to (table, column)."""
    said = None
    known = None
    for field, (table, column) in vocabularies.items():
        s = rows.select(F.lit(field).alias("field"), F.explode(field).alias("value"), F.col(key).alias("_row"))
        k = table.select(F.lit(field).alias("field"), F.col(column).alias("value")).distinct()
        said, known = (s, k) if said is None else (said.unionByName(s), known.unionByName(k))
    return said.join(known, ["field", "value"], "left_anti").groupBy("field", "value").agg(F.countDistinct("_row").alias("rows"))


def routed(claims: DataFrame, field: str, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(other claims, claims of ``field`` with the source that its entity type goes to): they are applied last, under that source."""
    own = sources.select("entity_type", F.col("source_id").alias("_source"))
    late = claims.filter(F.col("field_name") == field).join(own, "entity_type").withColumn("source_id", F.col("_source")).drop("_source")
    return claims.filter(F.col("field_name") != field), late


def broken_links(texts: DataFrame, id_: str, text: str, targets: DataFrame) -> DataFrame:
    """Links ``[[type:key]]`` of texts that lead nowhere: (id, type, key), against ``targets`` (type, key)."""
    links = texts.select(id_, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[([a-z-]+:[^\]|]+)"), F.lit(1)))).alias("_link"))
    parts = links.select(id_, F.substring_index("_link", ":", 1).alias("type"), F.trim(F.substring("_link", F.instr("_link", ":") + 1, F.length("_link"))).alias("key"))
    return parts.join(targets.select("type", "key").distinct(), ["type", "key"], "left_anti").select(id_, "type", "key")


def unrepresented(rows: DataFrame, key: str, local: DataFrame, local_key: str) -> DataFrame:
    """Distinct rows (by key) that nothing local stands for."""
    return rows.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(local.select(F.col(local_key).alias(key)), key, "left_anti")


def queued_names(credits: DataFrame, name: str, persons: DataFrame, person_name: str, id_: str) -> DataFrame:
    """Each name once, whatever its case: (name, person_id, handle). Known persons have an id; new ones a handle, by which claims name them until they exist."""
    known = persons.select(F.lower(person_name).alias("_key"), F.col(id_).alias("person_id")).groupBy("_key").agg(F.min("person_id").alias("person_id"))
    said = credits.groupBy(F.lower(F.trim(name)).alias("_key")).agg(F.min(F.trim(name)).alias("name")).filter("_key <> ''")
    both = said.join(known, "_key", "left")
    return both.select("name", "person_id", F.when(F.col("person_id").isNull(), F.concat(F.lit("person:"), "_key")).alias("handle"))


def titled_terms(refs: DataFrame, slug: str, existing: DataFrame) -> DataFrame:
    """New terms with a name made of the slug."""
    new = refs.select(slug).distinct().join(existing.select(slug), slug, "left_anti")
    return new.select(slug, F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))).alias("name"))


def brand_of(rows: DataFrame, steps: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """The first step that finds something: ``steps`` are (column of rows, table, its column, its id), ids in ``matched_id``, the step's place
    (from 1) in ``matched_by``. A value that several ids have in a table decides nothing."""
    out, found, by = rows, F.lit(None).cast("bigint"), F.lit(None).cast("int")
    for i, (column, table, of, id_) in enumerate(steps, 1):
        dim = table.groupBy(F.lower(of).alias(f"_k{i}")).agg(F.min(id_).alias(f"_i{i}"), F.countDistinct(id_).alias("_n")).filter("_n = 1").drop("_n")
        out = out.join(dim, F.lower(column) == F.col(f"_k{i}"), "left")
        found, by = F.coalesce(found, F.col(f"_i{i}")), F.coalesce(by, F.when(F.col(f"_i{i}").isNotNull(), i))
    return out.select(*rows.columns, found.alias("matched_id"), by.alias("matched_by"))


def backfilled(rows: DataFrame, group: str, id_: str, image: str) -> DataFrame:
    """Rows without an image take that of the sibling with the least id that has one; image_from says whose."""
    has = rows.filter(F.col(image).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.min(F.struct(F.col(id_).alias("i"), F.col(image).alias("u"))).alias("_best"))
    both = rows.join(has, F.col(group) == F.col("_g"), "left")
    return both.withColumn("image_from", F.when(F.col(image).isNotNull(), F.col(id_)).otherwise(F.col("_best.i"))).withColumn(image, F.coalesce(F.col(image), F.col("_best.u"))).drop("_g", "_best")
