"""Documents that pages are served from: titles with what their models share, makers and persons with counts, spans and the image to show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates as A


def _sorted(rows: DataFrame, group: str, item: Column, name: str) -> DataFrame:
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(item)).alias(name))


def title_documents(
    models: DataFrame, specs: list[str], shared: dict[str, DataFrame], counted: dict[str, DataFrame], identical: dict[str, DataFrame], credits: DataFrame, links: dict[str, str], media: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """One row a title of ``models`` (model_id, title_id, specs, link columns):

    * each of ``specs``: its value if every model has it and all have the same;
    * ``shared`` (name to model_id, value): values that every model has; ``counted`` (model_id, value, count): also, with the count if all agree;
      ``identical``: the set, if all models have the same one;
    * ``credits`` (model_id, person, role): those that every model has;
    * ``links`` (relation to a column of model ids): models of other titles that a model of this one comes from, as (relation, title_id, model_id);
    * ``media`` (model_id, asset_id): all models' assets, each once.

    Arrays are sorted, empty where there is nothing. A title's models are not gathered; sets are found by counting. Rows are dealt over ``parts`` partitions
    (by default as many as a shuffle has) by model for the bridges, then by title once: all that is made of a title is where it is joined."""
    n = parts or int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = models.select("model_id", "title_id").repartition(n, "model_id")
    out = models.repartition(n, "title_id").groupBy("title_id").agg(F.count(F.lit(1)).alias("models"), *[A.agreed(F.col(c)).alias(c) for c in specs])
    found: list[tuple[str, DataFrame]] = []

    def of(bridge: DataFrame) -> DataFrame:
        return mine.join(bridge, "model_id", "left")

    def sets(rows: DataFrame, item: Column, name: str) -> None:
        found.append((name, _sorted(rows.repartition(n, "title_id"), "title_id", item, name)))

    for name, bridge in shared.items():
        found.append((name, _sorted(A.shared_by_all(of(bridge), "title_id", "model_id", "value", parts=n), "title_id", F.col("value"), name)))
    for name, bridge in counted.items():
        found.append((name, _sorted(A.shared_with_payload(of(bridge), "title_id", "model_id", "value", "count", parts=n), "title_id", F.struct("value", "count"), name)))
    for name, bridge in identical.items():
        found.append((name, A.identical_sets(of(bridge), "title_id", "model_id", "value", parts=n).withColumnRenamed("values", name)))
    found.append(("credits", _sorted(A.shared_by_all(of(credits), "title_id", "model_id", "person", "role", parts=n), "title_id", F.struct("person", "role"), "credits")))
    theirs = mine.select(F.col("model_id").alias("_to"), F.col("title_id").alias("_other"))
    related = None
    for relation, column in links.items():
        rows = models.select("title_id", "model_id", F.col(column).alias("_to")).join(theirs, "_to").filter("_other <> title_id")
        rows = rows.select("title_id", F.struct(F.lit(relation).alias("relation"), F.col("_other").alias("title_id"), "model_id").alias("link"))
        related = rows if related is None else related.unionByName(rows)
    if related is not None:
        sets(related, F.col("link"), "related")
    if media is not None:
        sets(mine.join(media, "model_id"), F.col("asset_id"), "media")
    for _, part in found:
        out = out.join(part, "title_id", "left")
    kinds = dict(out.dtypes)
    return out.withColumns({n: F.coalesce(n, F.array().cast(kinds[n])) for n, _ in found})


def _thumbnail(models: DataFrame, by: str, *more: Column) -> DataFrame:
    """(by, thumbnail): the image of the newest model that has one; of equal years the first by ``more``, years unknown last."""
    order = F.struct(F.col("year").isNull(), -F.col("year"), *more)
    return models.filter("image IS NOT NULL").groupBy(by).agg(F.min_by("image", order).alias("thumbnail"))


def person_documents(people: DataFrame, aliases: DataFrame, credits: DataFrame, models: DataFrame) -> DataFrame:
    """Active people (entity_id, name, slug, status) with sorted aliases (entity_id, value), the number of their credits (person_id, model_id) and the image of the newest model
    (entity_id, year, image) that they are credited on."""
    count = credits.groupBy(F.col("person_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("credit_count"))
    said = _sorted(aliases, "entity_id", F.col("value"), "aliases")
    on = credits.select("person_id", F.col("model_id")).distinct().join(models.select(F.col("entity_id").alias("model_id"), "year", "image"), "model_id")
    thumb = _thumbnail(on, "person_id", F.col("model_id")).withColumnRenamed("person_id", "entity_id")
    rows = people.filter(A.active(F.col("status"))).select("entity_id", "name", "slug")
    rows = rows.join(count, "entity_id", "left").join(said, "entity_id", "left").join(thumb, "entity_id", "left")
    return rows.withColumns({"credit_count": F.coalesce("credit_count", F.lit(0)), "aliases": F.coalesce("aliases", F.array().cast("array<string>"))})


def maker_documents(makers: DataFrame, companies: DataFrame, models: DataFrame, places: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """Active makers (entity_id, name, slug, status) with what their companies (company_id, entity_id) made: models that are active and no variants (model_id, company_id, name, year,
    image, status, variant_of) counted, first and last year, image of the newest; all places of the companies (company_id, path) with those above them; and, from
    ``persons`` (model_id, person), everyone credited on those models."""
    own = models.filter(A.active(F.col("status")) & F.col("variant_of").isNull()).join(companies, "company_id")
    counts = own.groupBy("entity_id").agg(F.count(F.lit(1)).alias("model_count"), F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    thumb = _thumbnail(own, "entity_id", F.col("name"), F.col("model_id"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    located = _sorted(places.join(companies, "company_id").select("entity_id", F.explode(above).alias("path")), "entity_id", F.col("path"), "places")
    parts = [counts, thumb, located]
    if persons is not None:
        parts.append(_sorted(own.select("model_id", "entity_id").join(persons, "model_id"), "entity_id", F.col("person"), "persons"))
    rows = reduce(lambda a, b: a.join(b, "entity_id", "left"), parts, makers.filter(A.active(F.col("status"))).select("entity_id", "name", "slug"))
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("places", "persons") if c in rows.columns}
    return rows.withColumns({"model_count": F.coalesce("model_count", F.lit(0)), **empty})
