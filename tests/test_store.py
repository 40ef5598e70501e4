"""The bucketed store of claims: what it writes, two writers, runs that die, and random batches against a plain dictionary."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from attestry.sources.store import ClaimStore, Conflict

PENDING = "entity_type string, entity_id bigint, field_name string, claim_key string, value string, citation string, needs_review boolean, needs_review_notes string, license_id bigint, seq bigint"


def said(spark, rows):
    return spark.createDataFrame([("game", e, k, k, v, "", False, "", None, i) for i, (e, k, v) in enumerate(rows)], PENDING)


def live(store, version=None):
    return {(r.source_id, r.entity_id, r.claim_key): r.value for r in store.read("claims", version).filter("is_active").collect()}


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}/s", buckets=32)
    first = store.apply(said(spark, [(e, "name", f"n{e}") for e in range(500)]), 1)
    assert first["counts"] == {"create": 500} and first["buckets"] == 32
    before = files(tmp_path)
    run = store.apply(said(spark, [(7, "name", "new"), (7, "year", "1990")]), 1)
    assert run["counts"] == {"supersede": 1, "create": 1} and run["buckets"] == 1 and run["changesets"] == 1
    after = files(tmp_path)
    assert {p: after.get(p) for p in before} == before
    new = set(after) - set(before)
    size = {True: sum(Path(p).stat().st_size for p in before if "/claims/" in p), False: sum(Path(p).stat().st_size for p in new if "/claims/" in p)}
    assert size[False] < size[True] / 8
    assert len(live(store)) == 501 and live(store)[1, 7, "name"] == "new" and live(store, 1)[1, 7, "name"] == "n7"
    ids = [r.claim_id for r in store.read("claims").collect()]
    assert len(ids) == len(set(ids)) == 502 and max(ids) == 502
    # saying the same again changes nothing
    assert store.apply(said(spark, [(7, "name", "new")]), 1)["counts"] == {"unchanged": 1}
    assert store.vacuum() > 0 and len(live(store)) == 501


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one, two = ClaimStore(spark, root, buckets=4), ClaimStore(spark, root, buckets=4)
    one.apply(said(spark, [(1, "name", "a")]), 1)
    real, seen = two.versions.commit, []

    def late(version, content):
        if not seen:
            seen.append(version)
            one.apply(said(spark, [(1, "name", "b"), (2, "name", "c")]), 1)
        return real(version, content)

    two.versions.commit = late
    run = two.apply(said(spark, [(1, "name", "d")]), 1)
    assert seen == [2] and run["version"] == 3 and run["counts"] == {"supersede": 1}
    assert live(one) == {(1, 1, "name"): "d", (1, 2, "name"): "c"}
    two.versions.commit = lambda version, content: False
    with pytest.raises(Conflict):
        two.apply(said(spark, [(1, "name", "e")]), 1, tries=2)
    assert live(one)[1, 1, "name"] == "d"


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path):
    store = ClaimStore(spark, f"file://{tmp_path}/s", buckets=4)
    store.apply(said(spark, [(1, "name", "a"), (2, "name", "b")]), 1)
    write, seen = store._write, []

    def dying(rows, name, spread):
        if "changesets" in name:
            raise OSError("gone")
        write(rows, name, spread)
        seen.append(name)

    store._write = dying
    with pytest.raises(OSError):
        store.apply(said(spark, [(1, "name", "x")]), 1)
    assert seen and store.version() == 1
    again = ClaimStore(spark, f"file://{tmp_path}/s")
    assert again.buckets == 4 and live(again) == {(1, 1, "name"): "a", (1, 2, "name"): "b"}
    assert len(again.runs()) == 1 and again.vacuum() == 1
    assert again.apply(said(spark, [(1, "name", "x")]), 1)["counts"] == {"supersede": 1}


def test_random_batches(spark, tmp_path):
    rng, want = random.Random(2), {}
    store = ClaimStore(spark, f"file://{tmp_path}/s", buckets=8)
    for _ in range(4):
        source = rng.randrange(2)
        rows = [(rng.randrange(20), rng.choice(["name", "year"]), str(rng.randrange(3))) for _ in range(15)]
        run = store.apply(said(spark, rows), source, sweep=["year"])
        spoken = {(source, e, k): v for e, k, v in rows}
        entities = {e for e, _, _ in rows}
        gone = [x for x in want if x[0] == source and x[1] in entities and x[2] == "year" and x not in spoken]
        changed = {x[1] for x, v in spoken.items() if want.get(x) != v} | {x[1] for x in gone}
        want = {x: v for x, v in want.items() if x not in gone} | spoken
        assert live(store) == want and run["changesets"] == len(changed)
    sets = store.read("changesets").collect()
    assert sorted(r.changeset_id for r in sets) == list(range(1, len(sets) + 1)) and sum(r["changesets"] for r in store.runs()) == len(sets)
