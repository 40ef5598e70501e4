"""What only a fixpoint settles: unique columns with chains of displacement, cycles that several edges close together."""

from __future__ import annotations

import random

import pytest

from attestry.operators import hierarchy as Y
from attestry.operators import resolve as R

SCHEMA = "entity_id int, slug string"


def settle(spark, rows, before, nullable=False):
    got = R.settled(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(before, SCHEMA), "slug", nullable)
    return {r.entity_id: (r.slug, r.outcome) for r in got.collect()}


def brute(rows, before):
    """One loser after another goes back, until values are unique."""
    had, now = dict(before), {e: v or None for e, v in rows}
    lost = set()
    while True:
        clash = None
        for e in sorted(now):
            rivals = [o for o in now if o != e and now[o] is not None and now[o] == now[e]]
            if rivals:
                group = [e, *rivals]
                best = min(group, key=lambda o: (0 if now[o] == had.get(o) else 1, o))
                clash = [o for o in group if o != best]
                break
        if not clash:
            return {e: (v, "kept" if e not in lost else "cleared" if v is None else "reverted") for e, v in now.items()}
        for o in clash:
            assert o not in lost
            lost.add(o)
            now[o] = had.get(o) or None


def test_a_loser_displaces_who_took_its_value(spark):
    before = [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    # 1 wants b, 2 wants c, 3 wants d, which 4 keeps: all go back, the last by three steps
    assert settle(spark, [(1, "b"), (2, "c"), (3, "d"), (4, "d")], before) == {1: ("a", "reverted"), 2: ("b", "reverted"), 3: ("c", "reverted"), 4: ("d", "kept")}
    # a swap clashes with nobody; of two that want the same, the smaller id has it; one that is new has nothing to go back to
    assert settle(spark, [(1, "b"), (2, "a"), (3, "x"), (4, "x"), (5, "x"), (6, ""), (7, None)], before) == {
        1: ("b", "kept"), 2: ("a", "kept"), 3: ("x", "kept"), 4: ("d", "reverted"), 5: (None, "cleared"), 6: (None, "kept"), 7: (None, "kept"),
    }
    assert settle(spark, [(1, "x"), (2, "b"), (3, "b"), (4, "x")], before, nullable=True) == {1: ("x", "kept"), 2: ("b", "kept"), 3: (None, "cleared"), 4: (None, "cleared")}
    assert settle(spark, [], before) == {}


@pytest.mark.parametrize("seed", range(4))
def test_columns_are_unique(spark, seed):
    rng = random.Random(seed)
    n = 60
    before = [(i, f"v{i}") for i in range(n) if rng.random() < 0.9]
    rows = [(i, rng.choice([f"v{i}", f"v{rng.randrange(n)}", f"v{(i + 1) % n}", f"w{rng.randrange(10)}", "", None])) for i in range(n)]
    got = settle(spark, rows, before)
    assert got == brute(rows, before)
    values = [v for v, _ in got.values() if v is not None]
    assert len(values) == len(set(values))


def strong(edges):
    nodes = {x for e in edges for x in e}
    below = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not below[b] <= below[a]:
                below[a] |= below[b]
                changed = True
    parts = {}
    for n in nodes:
        mine = {m for m in below[n] if n in below[m]}
        if len(mine) > 1:
            parts[n] = max(mine)
    return parts


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range([30, 45, 70][seed])}) + [(n + i, n + i + 1) for i in range(12)] + [(n + 12, n)]
    got = Y.strong_components(spark.createDataFrame(edges, "child int, parent int"))
    assert {r.node: r.component for r in got.collect()} == strong(edges)
    existing, proposed = edges[::2], edges[1::2]
    parts = strong(edges)
    want = {(a, b) for a, b in proposed if a == b or (a in parts and parts[a] == parts.get(b))}
    named = Y.joint_cycles(*[spark.createDataFrame(e, "child int, parent int") for e in (existing, proposed)])
    assert {(r.child, r.parent) for r in named.collect()} == want and want


def test_two_edges_close_a_cycle_only_together(spark):
    existing = spark.createDataFrame([("b", "a"), ("d", "c")], "child string, parent string")
    proposed = spark.createDataFrame([("a", "d"), ("c", "b"), ("e", "a")], "child string, parent string")
    assert Y.makes_cycle(Y.closure(existing), proposed).isEmpty()
    assert sorted((r.child, r.parent) for r in Y.joint_cycles(existing, proposed).collect()) == [("a", "d"), ("c", "b")]
    assert Y.joint_cycles(existing, proposed.filter("child = 'e'")).isEmpty()
    assert Y.strong_components(existing.limit(0)).isEmpty()
