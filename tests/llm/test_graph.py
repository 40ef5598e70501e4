"""Connected components against union-find, with tasks that forget."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from attestry.llm import _graph as G


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("most", [500_000, 5])
def test_components(spark, monkeypatch, most):
    rng = random.Random(3)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 60)] + [(7, 7)]
    whole = G._contract
    monkeypatch.setattr(G, "_contract", lambda batches: whole((b for batch in batches for b in pa.Table.from_batches([batch]).to_batches(3)), most))
    got = {r["node"]: r["root"] for r in G.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8)).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])
    assert G.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
