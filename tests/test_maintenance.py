"""Incremental maintenance against tables made from scratch, over random batches of claims, by hand and as a stream."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestry.operators import maintenance as M
from attestry.operators.resolve import winners
from attestry.plans.specs import EntitySpec, FieldSpec
from attestry.streaming import jobs as J

PLACE = EntitySpec("place", (FieldSpec("slug"), FieldSpec("name"), FieldSpec("parent", target="place")))
MAKER = EntitySpec("maker", (FieldSpec("slug"), FieldSpec("name"), FieldSpec("place", target="place")))
GAME = EntitySpec("game", (FieldSpec("name"), FieldSpec("year", "int"), FieldSpec("maker", target="maker")), extra=True)
SPECS = [GAME, MAKER, PLACE]
DERIVED = [M.Copy("maker", "place_name", "place", "name"), M.Copy("game", "maker_name", "maker", "name"), M.Copy("game", "maker_place", "maker", "place_name"), M.Rollup("place", "n_makers", "parent", "maker", "place")]
CLAIMS = "claim_id bigint, entity_type string, entity_id bigint, field_name string, claim_key string, value string, created_at bigint, priority int, is_active boolean"


def batch(rng, first, n):
    """Claims of slugs, names, places and parents; slugs collide and change, parents make circles."""
    rows = []
    for i in range(first, first + n):
        kind = rng.choice(["place", "maker", "game"])
        e = rng.randrange({"place": 8, "maker": 6, "game": 12}[kind])
        name = rng.choice({"place": ["slug", "name", "parent"], "maker": ["slug", "name", "place"], "game": ["name", "year", "maker", "color"]}[kind])
        value = {"slug": f"{kind}{rng.choice([e, e, rng.randrange(8)])}", "name": f"n{rng.randrange(5)}", "parent": f"place{rng.randrange(8)}", "place": f"place{rng.randrange(8)}", "maker": f"maker{rng.randrange(6)}", "year": str(1980 + rng.randrange(9)), "color": "red"}[name]
        rows.append((i, kind, e, name, name, value, i, rng.randrange(2), True))
    return rows


def plain(df):
    return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())


def entities(spark):
    return {"place": spark.range(8).toDF("entity_id"), "maker": spark.range(6).toDF("entity_id"), "game": spark.range(12).toDF("entity_id")}


def test_incremental_is_full(spark):
    rng, log = random.Random(9), []
    log += batch(rng, 0, 60)
    tables = M.materialized(winners(spark.createDataFrame(log, CLAIMS)), SPECS, DERIVED, entities(spark))
    for step in range(4):
        new = batch(rng, len(log), [3, 10, 1, 25][step])
        log += new
        won = winners(spark.createDataFrame(log, CLAIMS))
        after = M.maintained(won, SPECS, DERIVED, spark.createDataFrame(new, CLAIMS), tables)
        full = M.materialized(won, SPECS, DERIVED, entities(spark))
        for s in SPECS:
            columns = full[s.name].columns
            assert plain(after[s.name].now().select(*columns)) == plain(full[s.name].select(*columns)), (step, s.name)
            tables[s.name] = after[s.name].now()
        tables = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in tables.items()}


def test_only_what_hangs_on_a_claim_is_computed(spark):
    claims = [(i, "place", i, f, f, v, i, 0, True) for i in range(8) for f, v in (("slug", f"place{i}"), ("name", f"p{i}"), ("parent", f"place{i // 2}" if i else None)) if v]
    claims += [(i, "maker", i, f, f, v, i, 0, True) for i in range(6) for f, v in (("slug", f"maker{i}"), ("name", f"m{i}"), ("place", f"place{i + 2}"))]
    claims += [(i, "game", i, "maker", "maker", f"maker{i % 6}", i, 0, True) for i in range(12)]
    before = M.materialized(winners(spark.createDataFrame(claims, CLAIMS)), SPECS, DERIVED, entities(spark))
    new = [(100, "maker", 5, "name", "name", "other", 100, 0, True)]
    after = M.maintained(winners(spark.createDataFrame(claims + new, CLAIMS)), SPECS, DERIVED, spark.createDataFrame(new, CLAIMS), before)
    assert {n: sorted(r.entity_id for r in t.rows.collect()) for n, t in after.items()} == {"place": [], "maker": [5], "game": [5, 11]}
    new = [(100, "maker", 5, "place", "place", "place2", 100, 0, True)]
    after = M.maintained(winners(spark.createDataFrame(claims + new, CLAIMS)), SPECS, DERIVED, spark.createDataFrame(new, CLAIMS), before)
    # place 7 is under 3, 1, 0 and place 2 under 1, 0
    assert sorted(r.entity_id for r in after["place"].rows.collect()) == [0, 1, 2, 3, 7]
    ways = M.edges(SPECS, DERIVED)
    assert (("place", "name"), ("maker", "place_name"), "rows with that id") in ways and (("maker", "place_id"), ("place", "n_makers"), "ancestors of the old and new place") in ways


def test_stream_is_full(spark, tmp_path):
    rng, root = random.Random(3), f"file://{tmp_path}/store"
    first = batch(rng, 0, 40)
    for name, t in M.materialized(winners(spark.createDataFrame(first, CLAIMS)), SPECS, DERIVED, entities(spark)).items():
        t.write.parquet(f"{root}/{name}/batch=-1")
    spark.createDataFrame(first, CLAIMS).write.parquet(f"{root}/claims/batch=-1")
    log = list(first)
    for _ in range(2):
        new = batch(rng, len(log), 12)
        log += new
        spark.createDataFrame(new, CLAIMS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(CLAIMS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = J.maintain_incrementally(stream, root, f"file://{tmp_path}/ck", SPECS, DERIVED, lambda c: c)
    q.processAllAvailable()
    q.stop()
    full = M.materialized(winners(spark.createDataFrame(log, CLAIMS)), SPECS, DERIVED, entities(spark))
    for s in SPECS:
        assert plain(J.current(spark, root, s.name).select(*full[s.name].columns)) == plain(full[s.name]), s.name
    assert spark.read.parquet(f"{root}/game").select(F.max("batch")).first()[0] == 1
