"""Features in running text: spans, the heaviest choice, number words, general terms that give way."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from attestry.operators import narratives as N

RULES = [
    N.Rule("multi-?ball", "multiball"), N.Rule("multi-?ball", "{n}-ball-multiball", 1, "multiball", "ball"), N.Rule("(?:upper|mini|elevated(?: \\w+)?) playfield", "upper-playfield"), N.Rule("playfield", "playfield"),
    N.Rule("ball save", "ball-save"), N.Rule("skill.?shot", "skill-shot", 3), N.Rule("shot multiball", "wrong", 2),
]


def test_heaviest_against_all_choices():
    rng = random.Random(1)
    for _ in range(400):
        items = [(a := rng.randrange(12), a + rng.randrange(1, 6), rng.randrange(1, 8)) for _ in range(rng.randrange(9))]
        got = N.heaviest(items)
        chosen = sorted(items[i] for i in got)
        assert all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False)) and len(set(got)) == len(got)
        best = 0
        for n in range(len(items) + 1):
            for some in itertools.combinations(sorted(items), n):
                if all(a[1] <= b[0] for a, b in zip(some, some[1:], strict=False)):
                    best = max(best, sum(w for _, _, w in some))
        assert sum(items[i][2] for i in got) == best


def test_numbers(spark):
    words = {"3": 3, "two": 2, "twenty-one": 21, "forty two": 42, "nineteen": 19, "one hundred and five": 105, "three hundred": 300, "two hundred thirty-four": 234, "a pair of": 2, "a dozen": 12, "many": None, "": None}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", N.number(F.col("w")).alias("n"))
    assert {r.w: r.n for r in rows.collect()} == words


def found(spark, texts, rules=RULES, parents=(), slugs=None):
    every = slugs or ["multiball", "2-ball-multiball", "3-ball-multiball", "upper-playfield", "playfield", "ball-save", "skill-shot", "wrong"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = N.features(rows, "id", "text", rules, spark.createDataFrame([(s,) for s in every], "slug string"), spark.createDataFrame(list(parents), "slug string, parent string") if parents else None)
    out = [set() for _ in texts]
    for r in got.collect():
        out[r.id].add((r.slug, r.n))
    return out


def test_features(spark):
    texts = [
        "Two-ball and 3 ball Multiball, then multiball again", "Nine-ball multiball", "An elevated glass playfield over the playfield.", "Skill shot multiball", "Ball saves and a ball save", None, "", "Multi-ball; MULTIBALL",
    ]
    got = found(spark, texts)
    assert got[0] == {("2-ball-multiball", 1), ("3-ball-multiball", 1), ("multiball", 1)}
    assert got[1] == {("multiball", 1)}  # no such slug: the general one
    assert got[2] == {("upper-playfield", 1), ("playfield", 1)}
    assert got[3] == {("skill-shot", 1), ("multiball", 1)}  # heavier together than the span across
    assert got[4] == {("ball-save", 1)} and got[5] == got[6] == set() and got[7] == {("multiball", 2)}
    parents = [("2-ball-multiball", "multiball"), ("3-ball-multiball", "multiball"), ("upper-playfield", "playfield")]
    got = found(spark, texts, parents=parents)
    assert got[0] == {("2-ball-multiball", 1), ("3-ball-multiball", 1)} and got[2] == {("upper-playfield", 1)} and got[7] == {("multiball", 2)}


def test_spans_are_places(spark):
    rng = random.Random(5)
    words = ["multiball", "mini playfield", "playfield", "x", "skill shot", "É", "🙂", "two", "3", "ball", "and", ","]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(15))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    import re

    got = N.spans(rows, "id", "text", RULES).collect()
    assert all(texts[r.id].lower()[r.begin : r.end] == r.found for r in got)
    want = {(i, n, m.start(), m.end()) for i, t in enumerate(texts) for n, rule in enumerate(RULES) for m in re.finditer(rule.regex(), t.lower())}
    assert {(r.id, r.rule, r.begin, r.end) for r in got} == want
    kept = N.settled(N.spans(rows, "id", "text", RULES), "id", RULES).collect()
    for i in range(len(texts)):
        mine = sorted((r.begin, r.end) for r in kept if r.id == i)
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:], strict=False))
        every = [(r.begin, r.end, RULES[r.rule].weight * (r.end - r.begin)) for r in got if r.id == i]
        assert sum(RULES[r.rule].weight * (r.end - r.begin) for r in kept if r.id == i) == sum(every[j][2] for j in N.heaviest(every))
