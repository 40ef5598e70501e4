"""Steps whose tasks must not grow with the tables: how rows are dealt, and that the dealt steps give what plain versions give."""

from __future__ import annotations

import random

from attestry.operators import _shared
from attestry.operators import aggregates as A
from attestry.sources.readers import table

SMALL = "/root/testdata/sf0.001"


def tasks(monkeypatch, query, spark, rows_a_task=100):
    monkeypatch.setattr(_shared, "ROWS_A_TASK", rows_a_task, raising=False)
    return query(spark, SMALL).rdd.getNumPartitions()


def shared_rows(spark, seed=4):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "u", "v"]), rng.choice([None, 1, 1])) for _ in range(60)]
    rows += [("all", m, "u", 7) for m in range(200)] + [("all", m, "w", m % 2) for m in range(200)] + [("all", 0, "one", 1), ("none", 1, None, None)]
    return rows, spark.createDataFrame(rows, "g string, m int, v string, p int")


def expected(rows):
    out = set()
    for g in {r[0] for r in rows} - {None}:
        members = {r[1] for r in rows if r[0] == g} - {None}
        for v in {r[2] for r in rows if r[0] == g} - {None}:
            mine = [r for r in rows if r[0] == g and r[2] == v]
            if {r[1] for r in mine} - {None} == members:
                told = {r[3] for r in mine}
                out.add((g, v, next(iter(told)) if len(told) == 1 else None))
    return out


def test_payloads_shared_by_dealt_members(spark, monkeypatch):
    """as many tasks as the lines need, the same values and payloads however many there are."""
    from attestry.catalogue.serving import common_with_payload

    lines = table(spark, SMALL, "lineitem").count()
    assert tasks(monkeypatch, common_with_payload, spark) == -(-lines // 100)
    rows, df = shared_rows(spark)
    want = expected(rows)
    assert ("all", "u", 7) in want and ("all", "w", None) in want
    for parts in (None, 1, 13):
        assert {tuple(r) for r in A.shared_with_payload(df, "g", "m", "v", "p", parts=parts).collect()} == want


def test_sets_shared_by_dealt_members(spark, monkeypatch):
    """as many tasks as the lines need, and the same values."""
    from attestry.catalogue.serving import common_set_intersection

    assert tasks(monkeypatch, common_set_intersection, spark) == -(-table(spark, SMALL, "lineitem").count() // 100)
    rows, df = shared_rows(spark, 5)
    for parts in (None, 13):
        assert {tuple(r) for r in A.shared_by_all(df, "g", "m", "v", parts=parts).collect()} == {x[:2] for x in expected(rows)}
        assert {(r.g, tuple(r["values"])) for r in A.identical_sets(df.filter("g = 'none' OR m > 0 AND g = 'all'"), "g", "m", "v", parts=parts).collect()} == {("all", ("u", "w"))}


def test_models_of_titles_are_made_once_and_dealt(spark, monkeypatch):
    """models are stored once, and documents come out of as many tasks as models need."""
    from attestry.catalogue import documents

    made = []
    monkeypatch.setattr(documents, "stored", lambda df, name: made.append(name) or _shared.stored(df, name), raising=False)
    models = table(spark, SMALL, "lineitem").select("l_orderkey", "l_linenumber").distinct().count()
    assert tasks(monkeypatch, documents.title_documents, spark) == -(-models // 100)
    assert made == ["models"]


def counting(monkeypatch, *modules):
    """Names of the tables that modules store, in order."""
    made = []
    for m in modules:
        monkeypatch.setattr(m, "stored", lambda df, name: made.append(name) or _shared.stored(df, name), raising=False)
    return made


def test_primary_rows_are_made_once(spark, monkeypatch):
    """neither what is attached nor the rows that change are made again for their categories; a chosen asset that isn't attached changes nothing."""
    from attestry.catalogue import details
    from attestry.operators import lifecycle as Z

    made = counting(monkeypatch, details, Z)
    assert details.primary_claims(spark, SMALL).count() > 0 and made == ["attached", "primary"]
    columns = "entity_type string, entity_id int, category string, asset_id int"
    media = spark.createDataFrame([("m", 1, "front", 5, True), ("m", 1, "front", 6, None), ("m", 1, "front", 8, False), ("m", 2, "front", 7, True), (None, 3, "front", 1, True)], columns + ", is_primary boolean")
    claims, _ = Z.primary_claims(media, spark.createDataFrame([("m", 1, "front", 8), ("m", 1, "front", 6), ("m", 1, "front", 4), ("m", 2, "front", 9), (None, 3, "front", 2)], columns))
    assert {(r.entity_id, r.claim_key.split("asset:")[1], "true" in r.value.split("is_primary")[1]) for r in claims.collect()} == {(1, "5", False), (1, "6", True)}


def test_terms_are_dealt_before_they_are_spread(spark, monkeypatch):
    """as many tasks as five terms a part need."""
    from attestry.catalogue.terms import vocabulary_claims

    assert tasks(monkeypatch, vocabulary_claims, spark, 50) == -(-table(spark, SMALL, "part").count() * 5 // 50)


def test_facet_rows_are_made_once(spark, monkeypatch):
    """every part of the index is made of one stored table of numbered documents."""
    from attestry.catalogue import facets
    from attestry.operators import facet_index as I

    made = counting(monkeypatch, I)
    facets.index(spark, SMALL)
    assert made == ["facets"]


def test_targets_are_read_once_a_value(spark, monkeypatch):
    """F8: JSON of relationship claims is written once and read once a value."""
    from attestry.catalogue import quality
    from attestry.operators import quality as Q
    from pyspark.sql import functions as F

    made = counting(monkeypatch, quality, Q)
    quality.dq_relationship_findings(spark, SMALL)
    assert made == ["claims", "values", "values"]
    claims = spark.createDataFrame([("credit|a", '{"person":1}')] * 3 + [("credit|b", '{"person":2}'), ("credit|c", "{}"), ("credit|d", None), ("other|a", '{"person":3}')], "claim_key string, value string")
    found = Q.unresolved(claims, "credit", F.get_json_object("value", "$.person"), spark.createDataFrame([("1",)], "k string"), "k")
    assert [r.subject for r in found.collect()] == ["2"]


def test_maintained_tables_are_stored_before(spark, monkeypatch):
    """winners are picked once before and once after, and what was materialized is a table."""
    from attestry.catalogue import maintenance

    made = counting(monkeypatch, maintenance)
    maintenance.maintained(spark, SMALL)
    assert sorted(made) == ["before", "before", "won", "won"]


def test_pages_to_make_are_judged_once(spark, monkeypatch):
    """works are matched once and the pages to make are stored before their slugs are numbered."""
    from attestry.catalogue import enrichment
    from attestry.operators import enrichment as E

    made = counting(monkeypatch, E)
    enrichment.persons_made(spark, SMALL)
    assert made == ["named", "new"]
