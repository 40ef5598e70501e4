"""Enrichment from encyclopedias: credits of works, pages of persons, facts of a knowledge graph, matched to what there is by name and said as claims.

Works are rows (title, person, role); entities rows (entity_id, name). Names match whatever their case; of several entities of one name the least id counts. Every row
that is not used has an outcome that says why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import last_name, slug
from ._shared import stored
from .claims import relationship_claim, unpivoted
from .matching import unique_slugs


def by_name(entities: DataFrame, key: str, id_: str) -> DataFrame:
    """(key, id) of lower-case names."""
    return entities.filter("name IS NOT NULL").groupBy(F.lower(F.trim("name")).alias(key)).agg(F.min("entity_id").alias(id_))


def matched_credits(works: DataFrame, machines: DataFrame, persons: DataFrame, roles: DataFrame) -> DataFrame:
    """Works with machine_id, person_id, role_slug and outcome: credit, or what was not found: game, person, role (the first of these)."""
    m, p = by_name(machines, "_m", "machine_id"), by_name(persons, "_p", "person_id")
    r = roles.select(F.col("slug").alias("_r")).distinct().withColumn("role_slug", F.col("_r"))
    out = works.join(m, F.lower(F.trim("title")) == F.col("_m"), "left").join(p, F.lower(F.trim("person")) == F.col("_p"), "left").join(r, F.lower(F.trim("role")) == F.col("_r"), "left")
    outcome = F.when(F.col("machine_id").isNull(), "no game").when(F.col("person_id").isNull(), "no person").when(F.col("role_slug").isNull(), "no role").otherwise("credit")
    return out.drop("_m", "_p", "_r").withColumn("outcome", outcome)


def credit_claims(matched: DataFrame, entity_type: str = "model", namespace: str = "credit") -> tuple[DataFrame, DataFrame]:
    """(claims, each once; scope: the games that were matched, whose credits are swept, with or without a credit that could be used)."""
    key, value = relationship_claim(namespace, {"person": F.col("person_id"), "role": F.col("role_slug")})
    claims = matched.filter("outcome = 'credit'").select(F.lit(entity_type).alias("entity_type"), F.col("machine_id").alias("entity_id"), F.lit(namespace).alias("field_name"), key.alias("claim_key"), value.alias("value")).distinct()
    scope = matched.filter("machine_id IS NOT NULL").select(F.lit(entity_type).alias("entity_type"), F.col("machine_id").alias("entity_id")).distinct()
    return claims, scope


def breakdown(matched: DataFrame) -> DataFrame:
    """What came of the works: (outcome, works, games, persons)."""
    return matched.groupBy("outcome").agg(F.count(F.lit(1)).alias("works"), F.countDistinct(F.lower("title")).alias("games"), F.countDistinct(F.lower("person")).alias("persons"))


def judged_pages(pages: DataFrame, works: DataFrame, machines: DataFrame, persons: DataFrame, credits: DataFrame) -> DataFrame:
    """Pages (title) of persons with person_id and outcome: ``no credits`` (no work names the page), ``matched``, ``near duplicate`` (who has a credit on one of the page's
    games shares its last word: near_id, the least), or ``create``. ``credits`` has machine_id and person_id as they stand."""
    named = works.select(F.lower(F.trim("person")).alias("_key"), F.lower(F.trim("title")).alias("_title")).distinct()
    named = stored(named, "named")  # both who is named and who stands beside them are read from it
    known = by_name(persons, "_p", "person_id")
    rows = pages.withColumn("_key", F.lower(F.trim("title"))).join(known, F.col("_key") == F.col("_p"), "left").drop("_p")
    rows = rows.join(named.select("_key").distinct().withColumn("_named", F.lit(True)), "_key", "left")
    # who is credited on a game, by the last word of the name: one row a game and word
    people = persons.select(F.col("entity_id").alias("person_id"), last_name(F.col("name")).alias("_last"))
    words = credits.select("machine_id", "person_id").distinct().join(people, "person_id").groupBy("machine_id", "_last").agg(F.min("person_id").alias("_near"))
    mine = named.join(by_name(machines, "_title", "machine_id"), "_title").withColumn("_last", F.element_at(F.split("_key", r"\s+"), -1))
    near = mine.join(words, ["machine_id", "_last"]).groupBy("_key").agg(F.min("_near").alias("near_id"))
    rows = rows.join(near, "_key", "left")
    outcome = F.when(F.col("_named").isNull(), "no credits").when(F.col("person_id").isNotNull(), "matched").when(F.col("near_id").isNotNull(), "near duplicate").otherwise("create")
    return rows.withColumn("outcome", outcome).withColumn("near_id", F.when(outcome == "near duplicate", F.col("near_id"))).drop("_key", "_named")


def new_persons(judged: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """Rows of the pages to make, with a slug that nobody has (``taken``: slug)."""
    new = stored(judged.filter("outcome = 'create'").withColumn("_base", slug(F.col("title"))), "new")  # slugs read them several times
    return unique_slugs(new, "_base", order, taken).drop("_base")


def fact_claims(facts: DataFrame, persons: DataFrame, fields: dict[str, str], entity_type: str = "person") -> tuple[DataFrame, DataFrame]:
    """(claims of the facts that are told, unmatched names). ``facts`` has name and columns; ``fields`` maps columns to fields of claims."""
    known = by_name(persons, "_p", "entity_id")
    both = facts.join(known, F.lower(F.trim("name")) == F.col("_p"), "left").drop("_p")
    rows = both.filter("entity_id IS NOT NULL").select("entity_id", *[F.col(c).alias(f) for c, f in fields.items()])
    claims = unpivoted(rows, "entity_id", list(fields.values())).distinct()
    said = claims.select(F.lit(entity_type).alias("entity_type"), "entity_id", "field_name", F.col("field_name").alias("claim_key"), "value")
    return said, both.filter("entity_id IS NULL").select("name").distinct()
