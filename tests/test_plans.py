"""Plans whose entities name one another."""

from __future__ import annotations

import random

from attestry.operators import generations as G
from attestry.plans.specs import RelationshipSpec

ENTITY = "handle string, seq bigint, entity_type string, identity map<string,string>, refs map<string,string>"
CREDIT = RelationshipSpec("credit", ("game",), {"person": "int", "role": "string"})


def made(spark, entities, existing=(), first=10):
    out, stuck = G.with_ids(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(existing), "entity_key string, entity_id bigint"), first)
    return out, {r.handle: (r.entity_id, r.entity_key, r.generation, r.is_new) for r in out.collect()}, {r.handle: r.fault for r in stuck.collect()}


def test_generations(spark):
    plan = [
        ("game", 1, "game", {"name": "Star|1"}, {"maker": "maker", "series": "series"}), ("maker", 2, "maker", {"name": "Acme"}, {"place": "place"}), ("place", 3, "place", {"name": "Rome"}, {}),
        ("series", 4, "series", {"name": "Sky"}, None), ("again", 5, "place", {"name": "Rome"}, {}),
    ]
    _, got, stuck = made(spark, plan, [("series|name:Sky", 3)])
    assert stuck == {}
    assert got["place"] == (10, "place|name:Rome", 0, True) and got["again"] == got["place"]
    assert got["series"] == (3, "series|name:Sky", 0, False)
    assert got["maker"] == (11, "maker|name:Acme|place:10", 1, True)
    assert got["game"] == (12, "game|maker:11|name:Star%7C1|series:3", 2, True)
    # the same plan again makes nothing
    _, again, _ = made(spark, plan, [(k, i) for i, k, _, _ in set(got.values())], 50)
    assert {h: r[0] for h, r in again.items()} == {h: r[0] for h, r in got.items()} and not any(r[3] for r in again.values())


def test_circles_and_unknown_handles(spark):
    plan = [
        ("a", 1, "x", {"n": "a"}, {"up": "b"}), ("b", 2, "x", {"n": "b"}, {"up": "c"}), ("c", 3, "x", {"n": "c"}, {"up": "a"}), ("hangs", 4, "x", {"n": "h"}, {"up": "a"}),
        ("lost", 5, "x", {"n": "l"}, {"up": "nowhere"}), ("self", 6, "x", {"n": "s"}, {"up": "self"}), ("fine", 7, "x", {"n": "f"}, {}),
    ]
    _, got, stuck = made(spark, plan)
    circle = "in a circle, or hangs on a fault"
    assert set(got) == {"fine"}
    assert stuck == {"a": circle, "b": circle, "c": circle, "hangs": circle, "self": circle, "lost": "names an unknown handle"}
    assert made(spark, [])[1:] == ({}, {})


def test_random_plans(spark):
    rng = random.Random(4)
    plan = [(f"h{i}", rng.randrange(1000), "t", {"n": str(i)}, {f"p{j}": f"h{j}" for j in rng.sample(range(i), min(i, rng.randrange(3)))}) for i in range(60)]
    shuffled = rng.sample(plan, len(plan))
    _, got, stuck = made(spark, shuffled)
    depth = {}
    for h, _, _, _, refs in plan:
        depth[h] = 1 + max((depth[r] for r in refs.values()), default=-1)
    assert stuck == {} and {h: r[2] for h, r in got.items()} == depth
    order = sorted(plan, key=lambda p: (depth[p[0]], p[1], got[p[0]][1]))
    assert [got[p[0]][0] for p in order] == list(range(10, 70))
    for h, _, _, identity, refs in plan:
        parts = {**identity, **{k: str(got[r][0]) for k, r in refs.items()}}
        assert got[h][1] == "|".join(["t", *[f"{k}:{parts[k]}" for k in sorted(parts)]])


def test_references_inside_keys(spark):
    out, got, _ = made(spark, [("ann", 1, "person", {"name": "Ann"}, {}), ("star", 2, "game", {"name": "Star"}, {})])
    rows = [
        (1, None, "star", "credit", None, {"role": "art"}, {"person": "ann"}), (2, 7, None, "credit", None, {"role": "de:sign"}, {"person": "ann"}), (3, None, "star", "name", "Star", None, None),
        (4, None, "gone", "name", "x", None, None), (5, 7, None, "credit", None, {"role": "art"}, {"person": "gone"}),
    ]
    said = spark.createDataFrame(rows, "seq int, entity_id bigint, handle string, field_name string, value string, identity map<string,string>, refs map<string,string>")
    claims, faults = G.with_references(said, out, [CREDIT])
    assert {r.seq: (r.entity_id, r.claim_key, r.value) for r in claims.collect()} == {
        1: (got["star"][0], "credit|person:10|role:art", '{"exists":true,"person":10,"role":"art"}'),
        2: (7, "credit|person:10|role:de%3Asign", '{"exists":true,"person":10,"role":"de:sign"}'),
        3: (got["star"][0], "name", "Star"),
    }
    assert {r.seq: r.fault for r in faults.collect()} == {4: "its entity was not made", 5: "names what was not made"}
