"""Queries over whole tables, on small fixtures with the rows that matter, against brute force."""

from __future__ import annotations

from _compare import DATA

from attestry import catalogue

ORIGINALS = ("café", "Müller & Söhne", "“quoted” – naïve", "Ærø, Łódź", "漢字", "€ 5", "Ÿ", "plain ascii")


def misread(text, decode):
    """``text`` in UTF-8, each byte read as one character."""
    return "".join(decode(b) for b in text.encode())


def cp1252(b):
    return bytes([b]).decode("cp1252", "ignore") or chr(b)


def is_garbled(text):
    """Character by character: the bytes that the text would have been, if every one of them is known, are other UTF-8."""
    if "\ufffd" in (text or ""):
        return True
    for decode in (cp1252, chr):
        back = {decode(b): b for b in range(256) if decode is chr or bytes([b]).decode("cp1252", "ignore")}
        if text and all(c in back for c in text):
            try:
                if bytes(back[c] for c in text).decode() != text:
                    return True
            except UnicodeDecodeError:
                pass
    return False


def test_garbled_documents(spark, tmp_path):
    texts = [*ORIGINALS, *(misread(t, f) for t in ORIGINALS for f in (cp1252, chr)), "x\ufffdy", "", None, "é", "Ã", "cafÃ© 漢"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["garbled"] for r in catalogue.QUERIES["garbled_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: is_garbled(t) for i, t in enumerate(texts)}
    assert sum(got.values()) >= 10 and got[texts.index("cafÃ©")] and got[texts.index("x\ufffdy")]
    assert not any(got[i] for i in range(len(ORIGINALS)))


def test_garbled_documents_has_every_row(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["garbled"] for r in catalogue.QUERIES["garbled_documents"](spark, f"{DATA}/sf0.01").collect()}
    assert got == {r["doc_id"]: is_garbled(r["text"]) for r in docs}


def test_nothing_is_filtered(spark):
    folder = f"{DATA}/sf0.01"
    lines, suppliers, parts = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("lineitem", "supplier", "part"))
    rows = {n: catalogue.QUERIES[n](spark, folder) for n in ("cascade_match_all", "near_duplicate_pairs_all", "relationship_claims_all", "sibling_counts", "golden_records_all")}
    assert rows["cascade_match_all"].count() == lines.count()
    assert rows["relationship_claims_all"].count() == lines.select("l_orderkey", "l_partkey").distinct().count()
    assert rows["golden_records_all"].count() == parts.filter("p_partkey % 3 = 0 AND p_brand <> 'Brand#0'").count() + 1

    by = {}
    for r in suppliers.collect():
        by.setdefault(r["s_nationkey"], set()).add(r["s_suppkey"])
    got = {(r["s_suppkey"], r["s_nationkey"]): r["siblings"] for r in rows["sibling_counts"].collect()}
    assert got == {(s, n): len(group) - 1 for n, group in by.items() for s in group}

    last = {r["p_partkey"]: r["p_name"].split()[-1] for r in parts.collect()}
    orders = {}
    for r in lines.select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r["l_orderkey"], set()).add(r["l_partkey"])
    want = {(a, b) for group in orders.values() for a in group for b in group if a < b and last[a] == last[b]}
    assert {tuple(r) for r in rows["near_duplicate_pairs_all"].collect()} == want and len(want) > 661
