"""A folder of exports, from files to resolved tables: what is made, what is warned of, what a second and a third load change."""

from __future__ import annotations

import json

import pytest

from attestry.operators.loads import LoadError
from attestry.sources import curated as K
from attestry.sources.store import ClaimStore

FILES = {
    "location": [
        {"location_path": "us", "name": "United States", "type": "country", "aliases": ["USA", "usa "]}, {"location_path": "us/il", "name": "Illinois", "type": "state"},
        {"location_path": "us/il/chicago", "name": "Chicago", "type": "city"}, {"location_path": "xx/nowhere", "name": "Nowhere", "type": "city"},
    ],
    "technology_generation": [{"slug": "ss", "name": "Solid state", "display_order": 2}], "technology_subgeneration": [{"slug": "dots", "name": "Dots", "technology_generation_slug": "ss"}, {"slug": "lost", "name": "Lost", "technology_generation_slug": "gone"}],
    "tag": [{"slug": "remake", "name": "Remake"}], "credit_role": [{"slug": "art", "name": "Art"}, {"slug": "design", "name": "Design"}],
    "theme": [{"slug": "space", "name": "Space", "parents": ["Sky"]}, {"slug": "sky", "name": "Sky", "description": "Above [[person:ann]]"}, {"slug": "odd", "name": "Odd", "parents": ["No such theme"]}],
    "gameplay_feature": [{"slug": "ramp", "name": "Ramp", "is_type_of": ["lane"]}, {"slug": "lane", "name": "Lane"}],
    "manufacturer": [{"slug": "acme", "name": "Acme", "description": "Maker"}], "corporate_entity": [{"slug": "acme-inc", "name": "Acme Inc", "manufacturer_slug": "acme", "year_start": 1950, "locations": ["us/il/chicago", "us/gone"]}, {"slug": "acme-inc", "name": "Twice", "manufacturer_slug": "acme"}],
    "system": [{"slug": "s1", "name": "System 1", "manufacturer_slug": "acme", "mpu_strings": ["MPU-1", "MPU-2"]}],
    "person": [{"slug": "ann", "name": "Ann", "aliases": ["Annie"]}, {"slug": "bob", "name": "Bob"}], "series": [{"slug": "stars", "name": "Stars", "credit_refs": [{"person_slug": "ann", "role": "design"}, {"person_slug": "ann", "role": "design"}, {"person_slug": "zed", "role": "art"}]}],
    "title": [{"slug": "star", "name": "Star", "series_slug": "stars", "franchise_slug": "gone", "abbreviations": ["ST", "S"], "description": "A game"}],
    "model": [
        {"slug": "star-1980", "name": "Star", "title_slug": "star", "corporate_entity_slug": "acme-inc", "year": 1980, "credit_refs": [{"person_slug": "ann", "role": "art"}, {"person_slug": "bob", "role": "design"}], "theme_slugs": ["space"], "gameplay_feature_slugs": ["ramp", "lane"], "tag_slugs": []},
        {"slug": "star-le", "name": "Star LE", "title_slug": "star", "variant_of": "star-1980", "year": 1981, "system_slug": "s1"}, {"slug": "orphan", "name": "Orphan", "title_slug": "no-title"},
    ],
}


def folder(tmp_path, files):
    tmp_path.mkdir(exist_ok=True)
    for name, rows in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    return f"file://{tmp_path}"


def read(spark, report, name):
    return [r.asDict(True) for r in spark.read.parquet(report.snapshots[name]).collect()]


def test_a_folder_of_exports(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    sources = spark.createDataFrame([(1, 10, True), (2, 20, True)], "source_id bigint, priority int, is_enabled boolean")
    first = K.load(spark, folder(tmp_path / "in", FILES), root, 1, sources, routes={"title": 2}, buckets=2)
    assert first.created["location"] == 3 and first.created["model"] == 2 and first.created["display_type"] == 0
    assert set(first.warnings) == {
        ("location", "missing parent_path", "xx"), ("technology_subgeneration", "missing technology_generation_slug", "gone"), ("theme", "unknown in parents", "No such theme"), ("corporate_entity", "repeated", "acme-inc"),
        ("corporate_entity", "unknown in locations", "us/gone"), ("title", "missing franchise_slug", "gone"), ("model", "missing title_slug", "no-title"),
    }
    places = {r["slug"]: r for r in read(spark, first, "location")}
    assert set(places) == {"us", "us/il", "us/il/chicago"} and places["us/il/chicago"]["parent_id"] == places["us/il"]["entity_id"] and places["us"]["parent_id"] is None
    assert [(r["alias"], r["display"]) for r in read(spark, first, "location.alias")] == [("usa", "USA")]
    models = {r["slug"]: r for r in read(spark, first, "model")}
    assert models["star-1980"]["year"] == 1980 and models["star-le"]["variant_of_id"] == models["star-1980"]["entity_id"] and models["star-le"]["system_id"] is not None
    titles = read(spark, first, "title")
    assert titles[0]["description"] == "A game" and titles[0]["series_id"] == read(spark, first, "series")[0]["entity_id"] and titles[0]["franchise"] is None
    assert {(r["person"], r["role"]) for r in read(spark, first, "model.credit")} == {("ann", "art"), ("bob", "design")} and all(r["person_id"] and r["role_id"] for r in read(spark, first, "model.credit"))
    themes = {r["slug"]: r["entity_id"] for r in read(spark, first, "theme")}
    assert [(r["entity_id"], r["parent_id"]) for r in read(spark, first, "theme.theme_parent")] == [(themes["space"], themes["sky"])]
    assert len(read(spark, first, "series.credit")) == 1 and {r["mpu"] for r in read(spark, first, "system.mpu_string")} == {"MPU-1", "MPU-2"}
    entity = read(spark, first, "corporate_entity")
    assert len(entity) == 1 and entity[0]["name"] == "Acme Inc" and len(read(spark, first, "corporate_entity.location")) == 1
    assert first.counts["description by 2"] == {"create": 1} and first.counts["description by 1"] == {"create": 2}
    store = ClaimStore(spark, f"{root}/store")
    ids = [(r.entity_type, r.entity_id) for r in K.register(store).collect()]
    assert len({i for _, i in ids}) == len(ids) == sum(first.created.values())

    # the same again: no entity, no claim
    claims = sorted(map(str, store.read("claims").collect()))
    again = K.load(spark, f"file://{tmp_path}/in", root, 1, sources, routes={"title": 2}, buckets=2)
    assert not any(again.created.values()) and {a for c in again.counts.values() for a in c} == {"unchanged"}
    assert sorted(map(str, store.read("claims").collect())) == claims
    for name in first.snapshots:
        assert sorted(map(str, read(spark, first, name))) == sorted(map(str, read(spark, again, name))), name

    # one credit gone, one year other, one theme more
    model = dict(FILES["model"][0], year=1982, credit_refs=FILES["model"][0]["credit_refs"][:1], theme_slugs=["space", "sky"])
    third = K.load(spark, folder(tmp_path / "in", {"model": [model, *FILES["model"][1:]]}), root, 1, sources, routes={"title": 2}, buckets=2)
    assert third.counts["model"] == {"supersede": 1, "create": 1, "sweep": 1, "unchanged": again.counts["model"]["unchanged"] - 2}
    assert all(set(c) <= {"unchanged"} for k, c in third.counts.items() if k != "model")
    assert {(r["person"], r["role"]) for r in read(spark, third, "model.credit")} == {("ann", "art")} and {r["theme"] for r in read(spark, third, "model.theme")} == {"space", "sky"}
    assert {r["slug"]: r["year"] for r in read(spark, third, "model")} == {"star-1980": 1982, "star-le": 1981}


def test_offenders_abort(spark, tmp_path):
    """A vocabulary slug that there is not stops the phase with all offenders named; nothing of it is written."""
    sources = spark.createDataFrame([(1, 10, True)], "source_id bigint, priority int, is_enabled boolean")
    phases = tuple(p for p in K.PHASES if p.entity in ("title", "tag", "model", "gameplay_feature"))
    phases = tuple(K.Phase(p.entity, p.file, p.schema, p.fields, tuple(r for r in p.refs if r.target in ("title", "model")), tuple(m for m in p.many if m.namespace in ("tag", "feature_parent"))) for p in phases)
    bad = {"title": FILES["title"], "tag": FILES["tag"], "model": [dict(FILES["model"][0], tag_slugs=["remake", "zz", "aa"])]}
    with pytest.raises(LoadError, match="aa, zz"):
        K.load(spark, folder(tmp_path / "in", bad), f"file://{tmp_path}/out", 1, sources, phases, buckets=2)
    have = {r.entity_type for r in K.register(ClaimStore(spark, f"file://{tmp_path}/out/store")).collect()}
    assert have == {"title", "tag"}
    with pytest.raises(LoadError, match="gone"):
        K.load(spark, folder(tmp_path / "in", {"gameplay_feature": [{"slug": "a", "name": "A", "is_type_of": ["gone"]}]}), f"file://{tmp_path}/out", 1, sources, phases, buckets=2)
