"""The ten operators' queries against SQL or brute force, on whole tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import _brute as B
import pytest
from _compare import DATA, compare

from attestry.llm import queries as Q

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, Q.QUERIES[name], Q.ORACLES[name], SMALL) is None


def test_language_id(spark):
    folder = f"{DATA}/sf0.01"
    rows = Q.op1_language_id(spark, folder).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held), (right, len(held))
    assert sum(not r["rejected"] for r in held) >= 0.9 * len(held)


def test_language_id_reruns_agree(spark):
    first, second = (sorted(map(tuple, Q.op1_language_id(spark, SMALL).collect())) for _ in range(2))
    assert first == second


def test_license_scan(spark, docs):
    rows = Q.op2_license_scan(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, found = B.base_licenses(docs[r["doc_id"]]["text"])
        places = [i for i, _ in found]
        base = ",".join(sorted({x for _, x in found}))
        want = (n, len(found), min(places, default=None), max(places, default=None), base)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(filter(None, base.split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_secret_scan(spark, docs):
    rows = Q.op6_secret_scan(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in B.base_secrets(docs[r["doc_id"]]["text"])]
        counts = Counter(x.split(":")[0] for x in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(","))


def test_jaccard_join(spark, docs):
    rows = Q.op10_jaccard_join(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == B.components([(i, d["text"]) for i, d in docs.items()], 4, 85, 100)


def test_pii_surrogates(spark, docs):
    """Texts change only where an entity was found, nothing that was found stays, and rewriting agrees between runs."""
    rows = Q.op7_pii_surrogates(spark, SMALL).collect()
    assert len(rows) == len(docs)
    again = {r["doc_id"]: r["text"] for r in Q.op7_pii_surrogates(spark, SMALL).collect()}
    for r in rows:
        before = docs[r["doc_id"]]["text"]
        assert (r["n_entities"] > 0) == (r["text"] != before)
        assert again[r["doc_id"]] == r["text"]
    assert sum(r["n_entities"] for r in rows) > 0


def test_sharding(spark, docs):
    rows = Q.op9_sharding(spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    per = Counter(r["shard"] for r in rows)
    assert all(r["shard_rows"] == per[r["shard"]] for r in rows)
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)


def test_pipeline(spark, docs):
    """Each stage against a brute-force version, on what the stage before kept."""
    import corpus_pipeline as P

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in Q.op4_quality_rules(spark, SMALL).collect() if r["kept"]}
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")

    def after(i, frame):
        from attestry.llm._spark import stage

        frame = stage(P.STAGES[i][1](spark, frame, SMALL), f"test-{i}")
        return frame, Counter(r["doc_id"] for r in frame.select("doc_id").collect())

    frame, got = after(0, frame)
    assert got == Counter(kept) and frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    comp = B.components([(i, docs[i]["text"]) for i in kept], 5, 80, 100)
    kept = {i for i in kept if comp[i][1] == i}
    frame, got = after(1, frame)
    assert got == Counter(kept)
    kept = {i for i in kept if not B.contaminated(docs[i]["text"], items)[1]}
    frame, got = after(2, frame)
    assert got == Counter(kept)
    mixed = B.mixed([(i, docs[i]["source"], docs[i]["text"]) for i in kept])
    frame, got = after(3, frame)
    assert got == mixed and frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    frame, got = after(4, frame)
    assert got == mixed
    run = Counter(r["doc_id"] for r in P.run(spark, SMALL).collect())
    assert run == mixed
