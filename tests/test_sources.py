"""Readers and sinks on small files of the documented shapes."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestry.sources import readers as R
from attestry.sources import sinks as S


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return f"file://{path}"


MACHINE = {
    "IpdbId": 20, "Title": "Star (2)", "Players": 4, "Manufacturer": "Acme Company [Trade Name: Ac]", "ManufacturerShortName": "Ac", "ManufacturerId": 3, "Type": "Pure Mechanical", "TypeShortName": "", "DateOfManufacture": "1980-01-01",
    "AverageFunRating": 7.5, "ProductionNumber": "1200", "ImageFiles": [{"Url": "http://x/1.jpg", "Name": "one"}], "DesignBy": "A, B",
}


def test_wrapped_machines(spark, tmp_path):
    rows = R.wrapped_machines(spark, write(tmp_path / "a.json", {"LastRefreshDateUtc": "x", "Data": [MACHINE, {"IpdbId": 21, "ProductionNumber": 500}]})).orderBy("ipdb_id").collect()
    assert [r["ipdb_id"] for r in rows] == [20, 21] and rows[0]["title"] == "Star (2)" and rows[1]["title"] == "" and rows[1]["players"] is None
    assert rows[1]["production_number"] == "500" and rows[0]["image_files"][0]["Url"] == "http://x/1.jpg" and len(rows[0]) == 27
    with pytest.raises(R.DriftError):
        R.wrapped_machines(spark, write(tmp_path / "b.json", {"Data": [MACHINE, {"Title": "no id"}]}))


def test_machine_array_and_exports(spark, tmp_path):
    entry = {"opdb_id": "G1-M2", "is_machine": True, "name": "Star", "ipdb_id": 20, "features": ["Ramp"], "manufacturer": {"manufacturer_id": 3, "name": "Acme"}, "images": [{"title": "t", "primary": True, "type": "backglass", "urls": {"large": "http://l"}}]}
    rows = R.machine_array(spark, write(tmp_path / "o.json", [entry, {"opdb_id": "G1-M2-A3", "is_alias": True}])).orderBy("opdb_id").collect()
    assert rows[0]["manufacturer"]["name"] == "Acme" and rows[0]["images"][0]["urls"]["large"] == "http://l" and rows[1]["is_alias"] and rows[1]["features"] is None
    write(tmp_path / "themes.json", [{"slug": "space", "name": "Space", "parents": ["sky"]}])
    folder, schema = f"file://{tmp_path}", "slug string, name string, parents array<string>"
    assert R.export(spark, folder, "themes", schema).collect()[0]["parents"] == ["sky"]
    assert R.export(spark, folder, "missing", schema).count() == 0


def binding(**values):
    return {k: {"type": "literal", "value": v} for k, v in values.items()}


def test_knowledge_graph(spark, tmp_path):
    dump = {
        "persons": {"results": {"bindings": [binding(person="http://w/Q1", personLabel="Ann"), binding(person="http://w/Q1", personLabel="Ann"), binding(person="http://w/Q2", personLabel="Bob")]}},
        "bio": {"results": {"bindings": [binding(person="http://w/Q1", birthDate="1950-02-01"), binding(person="http://w/Q1", deathDate="2001-01-01", birthDate="1950-02-01")]}},
        "credits": {"results": {"bindings": [binding(person="http://w/Q1", workLabel="Star", roleLabel="art"), binding(person="http://w/Q1", workLabel="Moon", roleLabel="art"), binding(person="http://w/Q1", workLabel="Star", roleLabel="art")]}},
        "manufacturers": {"results": {"bindings": [binding(manufacturer="http://w/Q9", manufacturerLabel="Acme"), binding(manufacturer="http://w/Q9", website="http://acme")]}},
    }
    path = write(tmp_path / "kg.json", dump)
    people = {r["qid"]: r for r in R.persons(spark, path).collect()}
    assert set(people) == {"Q1", "Q2"} and people["Q1"]["birth_date"] == "1950-02-01" and people["Q1"]["death_date"] == "2001-01-01"
    assert [tuple(c) for c in people["Q1"]["credits"]] == [("Moon", "art"), ("Star", "art")] and people["Q2"]["credits"] is None
    makers = R.makers(spark, path).collect()
    assert len(makers) == 1 and makers[0]["manufacturer_label"] == "Acme" and makers[0]["website"] == "http://acme"


def test_wiki(spark, tmp_path):
    text = "{{Infobox\n|name = Star\n|designer = '''Design''': Ann, Bob\n}}\nA game."
    path = write(tmp_path / "w.json", {"games": [{"page_id": 1, "title": "Star", "wikitext": text}, {"page_id": 2, "title": "Old", "wikitext": " #redirect [[Star]]"}]})
    rows = R.wiki_games(spark, path).collect()
    assert len(rows) == 1 and rows[0]["fields"]["name"] == "Star"
    assert {(c["role"], c["name"]) for c in rows[0]["credits"]} == {("Design", "Ann"), ("Design", "Bob")}


def test_seeds_and_fingerprints(spark, tmp_path):
    tree = [{"name": "books", "children": [{"name": "a", "url": "http://a"}, {"name": "b", "children": [{"name": "c"}]}]}]
    assert [(r["path"], r["parent"], r["url"]) for r in R.seed_nodes(spark, tree).collect()] == [("books", None, None), ("books/a", "books", "http://a"), ("books/b", "books", None), ("books/b/c", "books/b", None)]
    (tmp_path / "d").mkdir()
    for n, c in (("x", b"one"), ("y", b"two")):
        (tmp_path / "d" / n).write_bytes(c)
    local = R.fingerprints(spark, f"file://{tmp_path}/d/*").withColumn("name", F.substring_index("path", "/", -1))
    assert {r["name"]: r["sha256"] for r in local.collect()} == {"x": hashlib.sha256(b"one").hexdigest(), "y": hashlib.sha256(b"two").hexdigest()}
    manifest = spark.createDataFrame([("x", 3, hashlib.sha256(b"one").hexdigest()), ("y", 3, "other"), ("z", 1, "new")], "name string, bytes bigint, sha256 string")
    assert sorted(r["name"] for r in R.to_fetch(manifest, local).collect()) == ["y", "z"]


def test_upserts(spark):
    have = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", None)], "id int, name string, n int")
    rows = spark.createDataFrame([(2, "B"), (3, "c"), (4, "d")], "id int, name string")
    got = {r["id"]: tuple(r)[1:] for r in S.upserted(have, rows, ["id"]).collect()}
    assert got == {1: ("a", 10, "unchanged"), 2: ("B", 20, "updated"), 3: ("c", None, "unchanged"), 4: ("d", None, "created")}
    assert sorted(r["id"] for r in S.add_missing(have, rows.unionByName(rows), ["id"]).collect()) == [1, 2, 3, 4]


def test_tags_follow_content(spark):
    rows = [spark.createDataFrame([(1, x)], "id int, name string") for x in ("a", "a", "b")]
    tags = [S.tagged(r).collect()[0] for r in rows]
    assert tags[0]["etag"] == tags[1]["etag"] != tags[2]["etag"] and tags[0]["etag"] == hashlib.md5(tags[0]["payload"].encode()).hexdigest()
    assert json.loads(tags[0]["payload"]) == {"id": 1, "name": "a"}


def test_snapshots_and_records(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    first = S.snapshot(spark.range(3), root)
    second = S.snapshot(spark.range(5).withColumn("k", F.col("id") % 2), root, ["k"])
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).filter("k = 1").count() == 2
    log = f"file://{tmp_path}/runs"
    assert S.recorded(spark, log, "load", lambda: {"rows": 3}) == {"rows": 3}

    def fails():
        raise KeyError("lost")

    with pytest.raises(KeyError):
        S.recorded(spark, log, "load", fails)
    runs = {r["status"]: r for r in spark.read.parquet(log).collect()}
    assert runs["done"]["counts"] == {"rows": 3} and "lost" in runs["failed"]["error"] and runs["failed"]["counts"] == {}
