"""What the pipeline's stages leave: one row of each class, whatever its ids and other columns; the same beyond the benchmark's index."""

from __future__ import annotations

from _brute import shingles

from attestry.llm import decontamination, jaccard_join

BASE = " ".join(f"w{i}" for i in range(60))
SCHEMA = "doc_id bigint, text string, tags map<string,int>, _hash string"


def near(i, base=BASE):
    return f"{base} tail{i}"


def rows(*of):
    return [(i, t, {"a": n}, f"row{n}") for n, (i, t) in enumerate(of)]


def test_one_row_of_each_class(spark):
    """Null ids, repeated ids, near but unequal texts, repeated rows, texts without words."""
    other, third = BASE.replace("w", "x"), BASE.replace("w", "y")
    data = rows((None, near(1)), (None, near(2)), (7, near(1, other)), (7, near(2, other)), (8, near(1, third)), (9, near(2, third)), (8, near(1, third)), (5, ""), (5, ""), (None, None))
    got = jaccard_join.keep_one(spark.createDataFrame(data, SCHEMA), k=5, p=80, q=100).collect()
    assert got[0].__fields__ == ["doc_id", "text", "tags", "_hash"]
    words = [r for r in got if r.text]
    assert len(words) == 3
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in words) == [(False, 7), (False, 8), (True, 0)]
    assert [r for r in words if r.doc_id == 8][0].text == near(1, third)
    assert len(got) - len(words) == 3  # linked with nothing
    again = jaccard_join.keep_one(spark.createDataFrame(list(reversed(data)), SCHEMA), k=5, p=80, q=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_row_with_an_id_goes_before_one_without(spark):
    got = jaccard_join.keep_one(spark.createDataFrame(rows((None, near(1)), (3, near(2)), (2, near(3))), SCHEMA), k=5, p=80, q=100).collect()
    assert [r.doc_id for r in got] == [2]


def test_random_classes(spark):
    import random

    random.seed(3)
    data = []
    for c in range(25):
        base = [f"c{c}w{random.randrange(1000)}" for _ in range(50)]
        for _ in range(random.randrange(1, 6)):
            t = list(base)
            t[random.randrange(50)] = f"z{random.randrange(10**6)}"
            data.append((random.choice([None, c, random.randrange(5)]), " ".join(t)))
    sets = [shingles(t, 5) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    classes = {t: find(i) for i, (_, t) in enumerate(data)}
    got = jaccard_join.keep_one(spark.createDataFrame(rows(*data), SCHEMA), k=5, p=80, q=100).collect()
    assert sorted(classes[r.text] for r in got) == sorted(set(classes.values()))
    for r in got:
        ids = [i for i, t in data if classes[t] == classes[r.text] and i is not None]
        assert r.doc_id == (min(ids) if ids else None)


def test_contaminated_rows_go_on_both_sides_of_the_switch(spark):
    item = " ".join(f"q{i}" for i in range(14))
    data = rows((1, f"before {item} after"), (1, "clean text"), (None, f"x {item}"), (None, None), (4, "clean text"), (5, " ".join(item.split()[:9])))
    docs, bench = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("i", item), ("j", "two words"), (None, None)], "item_id string, text string")
    sides = [sorted(map(str, decontamination.remove_contaminated(docs, bench, max_windows=n).collect())) for n in (2_000_000, 0)]
    assert sides[0] == sides[1]
    assert len(sides[0]) == 4


def test_fixed_forms_never_change(spark):
    """Two million values of each fixed form, more than the reserved ranges hold without clashes: distinct, well-formed, none an original."""
    from pyspark.sql import functions as F

    from attestry.llm import pii_surrogates

    n, i = 2_000_000, F.col("id")
    ip = F.concat_ws(".", (F.lit(240) + i % 15).cast("string"), (i % 256).cast("string"), ((i / 256).cast("bigint") % 256).cast("string"), ((i / 65536).cast("bigint") % 256).cast("string"))
    forms = {"ip": ip, "ssn": F.lpad((i + 899_000_000).cast("string"), 9, "0"), "phone": F.lpad((i * 7).cast("string"), 10, "5"), "card": F.concat(F.lit("4"), F.lpad(i.cast("string"), 15, "0"))}
    entities = None
    for kind, form in forms.items():
        rows = spark.range(n).select(F.lit(kind).alias("kind"), form.alias("norm"))
        entities = rows if entities is None else entities.unionByName(rows)
    entities = entities.distinct()
    codes = pii_surrogates.surrogate_map(entities, "k")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    formed = F.when(F.col("kind") == "ip", F.col("code").rlike(rf"^{octet}(\.{octet}){{3}}$")).otherwise((F.length("code") == F.length("norm")) & F.col("code").rlike("^[0-9]+$"))
    got = codes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~formed).alias("bad")).collect()
    want = {r.kind: r.n for r in entities.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.kind: (r.n, r.bad) for r in got} == {k: (v, 0) for k, v in want.items()}
    assert codes.select("kind", "code").distinct().count() == sum(want.values())
    assert codes.join(entities.withColumnRenamed("norm", "code"), ["kind", "code"], "left_semi").isEmpty()
