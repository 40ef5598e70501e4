"""Typed readers: table folders, machine dumps, SPARQL results, wiki dumps, curated exports, seed trees, binary fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DriftError(ValueError):
    """An input does not have the shape it is documented to have."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


MACHINES = (
    "IpdbId int, Title string, Players int, Manufacturer string, ManufacturerShortName string, ManufacturerId int, Type string, TypeShortName string, DateOfManufacture string, "
    "Theme string, AverageFunRating double, ModelNumber string, ProductionNumber string, NotableFeatures string, Notes string, Toys string, MarketingSlogans string, "
    "CommonAbbreviations string, MPU string, ImageFiles array<struct<Url:string,Name:string>>, DesignBy string, ArtBy string, DotsAnimationBy string, MechanicsBy string, MusicBy string, "
    "SoundBy string, SoftwareBy string"
)
OPEN_MACHINES = (
    "opdb_id string, is_machine boolean, is_alias boolean, name string, common_name string, shortname string, physical_machine int, ipdb_id int, manufacture_date string, type string, "
    "display string, player_count int, features array<string>, keywords array<string>, description string, "
    "manufacturer struct<manufacturer_id:int,name:string,full_name:string,created_at:string,updated_at:string>, "
    "images array<struct<title:string,primary:boolean,type:string,urls:struct<small:string,medium:string,large:string>>>, created_at string, updated_at string"
)


def snake(name: str) -> str:
    return "".join(("_" + c.lower()) if c.isupper() and i and not name[i - 1].isupper() else c.lower() for i, c in enumerate(name))


def split_rows(spark: SparkSession, path: str, at: str, schema: str, chunk: int) -> DataFrame:
    """Records under ``at`` of one JSON document, read by tasks of ``chunk`` bytes; corrupt ones abort, and how many there are is told."""
    from .json_records import parsed, records

    good, bad = parsed(records(spark, path, at, chunk), schema)
    if n := bad.count():
        raise DriftError(f"{path}: {n} corrupt records, such as {[tuple(r) for r in bad.limit(3).collect()]}")
    return good


def wrapped_machines(spark: SparkSession, path: str, required: str = "IpdbId", chunk: int | None = None) -> DataFrame:
    """Rows under ``Data`` of one JSON document, snake-case columns with '' for missing texts. A row without the required key aborts. With ``chunk`` (bytes)
    a large document is read by many tasks."""
    machine = spark.createDataFrame([], MACHINES).schema
    rows = split_rows(spark, path, "Data", MACHINES, chunk) if chunk else spark.read.schema(T.StructType([T.StructField("Data", T.ArrayType(machine))])).option("multiLine", True).json(path).select(F.inline("Data"))
    if not rows.filter(F.col(required).isNull()).isEmpty():
        raise DriftError(f"{path}: rows without {required}")
    return rows.select(*[(F.coalesce(f.name, F.lit("")) if f.dataType == T.StringType() else F.col(f.name)).alias(snake(f.name)) for f in machine])


def machine_array(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    if chunk:
        return split_rows(spark, path, "", OPEN_MACHINES, chunk)
    return spark.read.schema(OPEN_MACHINES).option("multiLine", True).json(path)


def export(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A per-entity export (JSON array); a file that is not there is an empty table."""
    path = f"{folder}/{name}.json"
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


_VALUE = "struct<type:string,value:string>"


def bindings(spark: SparkSession, path: str, part: str, chunk: int | None = None) -> DataFrame:
    """SPARQL result rows of one part of a dump: a map from variable to value."""
    if chunk:
        from .json_records import records

        rows = records(spark, path, f"{part}.results.bindings", chunk).select(F.from_json("record", f"map<string,{_VALUE}>").alias("b"))
        return rows.select(F.transform_values("b", lambda _, v: v["value"]).alias("b"))
    schema = f"{part} struct<results:struct<bindings:array<map<string,{_VALUE}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(f"{part}.results.bindings").alias("b"))
    return rows.select(F.transform_values("b", lambda _, v: v["value"]).alias("b"))


def entity_id(uri: Column) -> Column:
    """Last segment of an entity's address."""
    return F.substring_index(uri, "/", -1)


def persons(spark: SparkSession, path: str) -> DataFrame:
    """Persons of a knowledge-graph dump: a stub each, biography facts (first one that is given), works as a sorted array."""
    stubs = bindings(spark, path, "persons").select(entity_id(F.col("b.person")).alias("qid"), F.col("b.personLabel").alias("name")).dropDuplicates(["qid"])
    facts = bindings(spark, path, "bio").select(entity_id(F.col("b.person")).alias("qid"), "b")
    names = ("birthDate", "birthPrecision", "deathDate", "deathPrecision", "birthPlaceLabel", "nationalityLabel", "image")
    # min is a first that doesn't depend on the order of rows
    facts = facts.groupBy("qid").agg(*[F.min(F.col("b")[n]).alias(snake(n)) for n in names])
    works = bindings(spark, path, "credits").select(entity_id(F.col("b.person")).alias("qid"), F.struct(F.col("b.workLabel").alias("work"), F.col("b.roleLabel").alias("role")).alias("w"))
    works = works.groupBy("qid").agg(F.sort_array(F.collect_set("w")).alias("credits"))
    return stubs.join(facts, "qid", "left").join(works, "qid", "left")


def makers(spark: SparkSession, path: str) -> DataFrame:
    rows = bindings(spark, path, "manufacturers").select(entity_id(F.col("b.manufacturer")).alias("qid"), "b")
    names = ("manufacturerLabel", "description", "inception", "dissolved", "countryLabel", "headquartersLabel", "website", "logo")
    return rows.groupBy("qid").agg(*[F.min(F.col("b")[n]).alias(snake(n)) for n in names])


def wiki_pages(spark: SparkSession, path: str, part: str, chunk: int | None = None) -> DataFrame:
    """Pages of one part of a wiki dump (page_id, title, wikitext) without redirects."""
    schema = f"{part} array<struct<page_id:int,title:string,wikitext:string>>"
    rows = split_rows(spark, path, part, "page_id int, title string, wikitext string", chunk) if chunk else spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline(part))
    return rows.filter(~F.coalesce(F.upper(F.ltrim("wikitext")).startswith("#REDIRECT"), F.lit(False)))


def wiki_games(spark: SparkSession, path: str, template: str = "Infobox") -> DataFrame:
    """Game pages with the fields of their infobox and credits as (role, name)."""
    from ..functions.wikitext import labelled_credits, template_fields

    pages = wiki_pages(spark, path, "games").withColumn("fields", template_fields(F.col("wikitext"), template))
    return pages.select("page_id", "title", "fields", F.coalesce(labelled_credits(F.col("fields")["designer"]), F.array().cast("array<struct<role:string,name:string>>")).alias("credits"))


def seed_nodes(spark: SparkSession, tree: list[dict]) -> DataFrame:
    """A seed tree (dicts with name, url, children) as rows with the path of names; seeds are small configuration."""
    rows, todo = [], [((), n) for n in tree]
    while todo:
        path, node = todo.pop()
        here = (*path, node["name"])
        rows.append(("/".join(here), "/".join(path) or None, node["name"], node.get("url")))
        todo += [(here, c) for c in node.get("children", [])]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "path string, parent string, name string, url string")


def fingerprints(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of input files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def to_fetch(manifest: DataFrame, local: DataFrame) -> DataFrame:
    """Manifest entries (name, bytes, sha256) that no local file matches."""
    return manifest.join(local.select("name", "bytes", "sha256"), ["name", "bytes", "sha256"], "left_anti")
