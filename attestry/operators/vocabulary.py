"""Lines of features and their vocabularies, links within texts, citations copied to claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ``[[type:ref]]``
LINK = r"\[\[([a-z-]+):([^\]|]+)\]\]"


def feature_parts(line: Column) -> Column:
    """Items of a line, cut at commas outside parentheses and at ends of sentences, as (name, count); the count of ``Name (4)`` is 4, else null."""
    parts = F.transform(F.split(F.coalesce(line, F.lit("")), r",(?![^()]*\))|\.(?:\s+|$)"), lambda p: F.trim(p))
    number = r"\s*\(([0-9]{1,9})\)$"
    return F.transform(
        F.filter(parts, lambda p: p != ""),
        lambda p: F.struct(F.regexp_replace(p, number, "").alias("name"), F.nullif(F.regexp_extract(p, number, 1), F.lit("")).cast("int").alias("count")),
    )


def sorted_terms(rows: DataFrame, key: str, terms: str, vocabularies: dict[str, DataFrame], single: tuple[str, ...] = (), ignored: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Each term of the array ``terms`` in the first vocabulary (term, slug) that knows it, whatever its case: (key, place, term, kind, slug).

    A slug comes once a row and kind, where it stands first; kinds in ``single`` keep their last term only. Unknown terms have null kind
    and slug, but for those in ``ignored``. One join for all vocabularies: they are merged by term first, the earlier one winning. Rows are dealt over ``parts`` partitions
    (by default as many as a shuffle has) by key before they are spread over their terms."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = None
    for rank, (kind, words) in enumerate(vocabularies.items()):
        part = words.select(F.lower("term").alias("_term"), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "slug").alias("known"))
        merged = part if merged is None else merged.unionByName(part)
    merged = merged.filter("_term IS NOT NULL").groupBy("_term").agg(F.min("known").alias("known"))
    each = rows.select(key, terms).repartition(n, key).select(key, F.posexplode(terms).alias("place", "term")).filter("term IS NOT NULL")
    found = each.join(merged, F.lower("term") == F.col("_term"), "left").select(key, "place", "term", "known.kind", "known.slug")
    found = found.filter(F.col("kind").isNotNull() | ~F.col("term").isin(*ignored))
    last = F.coalesce(F.col("kind").isin(*single), F.lit(False))
    unit = F.when(F.col("kind").isNull(), F.col("place").cast("string")).when(~last, F.col("slug"))
    picked = F.when(last, F.col("place")).otherwise(-F.col("place"))  # the greatest is the one to keep
    kept = found.groupBy(key, "kind", unit.alias("_unit")).agg(F.max(F.struct(picked.alias("picked"), "place", "term", "slug")).alias("x"))
    return kept.select(key, "x.place", "x.term", "kind", "x.slug")


def preview(label: Column, most: int = 30) -> Column:
    """A label fit for a link: no brackets, single blanks, cut behind ``most`` characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(label, r"[\[\]]", ""), r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("..."))).otherwise(clean)


def rendered_links(rows: DataFrame, key: str, text: str, targets: DataFrame, numbered: tuple[str, ...] = (), broken: str = "[broken link]") -> DataFrame:
    """(key, text, n_links): ``[[type:ref]]`` as ``[label](url)`` of its target (type, ref, label, url; of several the least label), or as its number
    among the row's links of the type, by first appearance, for the types in ``numbered``. Links that lead nowhere read ``broken``.

    ``key`` names one row. Texts without a link, and null ones, don't enter the join."""
    linked = F.coalesce(F.col(text).rlike(LINK), F.lit(False))
    cut = rows.filter(linked).select(key, F.split(text, LINK).alias("segments"), F.regexp_extract_all(text, F.lit(LINK), F.lit(0)).alias("links"))
    each = cut.select(key, F.posexplode(F.array_distinct("links")).alias("place", "link"))
    each = each.withColumns({"type": F.regexp_extract("link", LINK, 1), "ref": F.regexp_extract("link", LINK, 2)})
    each = each.withColumn("n", F.row_number().over(W.partitionBy(key, "type").orderBy("place")))
    one = targets.groupBy("type", "ref").agg(F.min(F.struct("label", "url")).alias("t")).select("type", "ref", "t.label", "t.url", F.lit(True).alias("there"))
    found = each.join(one, ["type", "ref"], "left")
    number = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"))
    shown = F.when(F.col("there").isNull(), F.lit(broken)).when(F.col("type").isin(*numbered), number)
    shown = shown.otherwise(F.concat(F.lit("["), F.coalesce(preview(F.col("label")), F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")")))
    per = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("link", shown.alias("shown")))).alias("shown"))
    rebuilt = F.array_join(F.transform("segments", lambda s, i: F.concat(s, F.coalesce(F.element_at("shown", F.get("links", i)), F.lit("")))), "")
    done = cut.join(per, key).select(key, rebuilt.alias(text), F.size("links").alias("n_links"))
    return done.unionByName(rows.filter(~linked).select(key, text, F.lit(0).alias("n_links")))


def with_citations(claims: DataFrame, templates: list[tuple[int, str]]) -> DataFrame:
    """Every claim with a copy of each template citation (source, locator); an edit form holds a handful of them."""
    copies = F.array(*[F.struct(F.lit(source).alias("citation_source_id"), F.lit(locator).alias("locator")) for source, locator in templates])
    return claims.select("*", F.inline(copies))
