"""Centroid clustering, chat formatting and the source audit: against plain versions on small tables, and on the edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import chat_format, delta_lloyd, divergence

# --- centroid clustering


def lloyd(rows, k, rounds, dim):
    """[(id, vector)] to ({row: (cluster, distance)}, centroids), Python's integers throughout."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, of, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((str(i), c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), centroids


def vectors(n, dim, seed=0):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.3) for x in middles[i % 5]]) for i in range(n)]


@pytest.mark.parametrize("k,rounds", [(7, 5), (3, 1), (12, 9)])
def test_lloyd_by_transfers(spark, k, rounds):
    rows = vectors(300, 6) + [(1000 + i, [0.25] * 6) for i in range(40)]  # a heap of equal vectors
    rows += [(900, None), (901, [1.0] * 5), (902, [1.0] * 7), (903, [None] * 6), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5), (906, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"x": F.lit("own"), "cluster": F.lit("own"), "key": F.lit("own")})
    got, centroids, did = delta_lloyd.cluster(table.repartition(5), k=k, rounds=rounds, dim=6)
    want, middles = lloyd(rows, k, rounds, 6)
    assert sorted((str(r.key), r.cluster, r.distance) for r in got.collect()) == want
    assert centroids.tolist() == middles
    # the first round compares all with all, later ones less
    assert did[0] == {"changed": k, "moves": 340} and all(d["moves"] < 340 for d in did[1:])


def test_lloyd_ends_when_nothing_moves(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)]
    got, centroids, did = delta_lloyd.cluster(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), k=2, rounds=50, dim=2)
    assert len(did) < 5
    want, middles = lloyd(rows, 2, 50, 2)
    assert sorted((str(r.key), r.cluster, r.distance) for r in got.collect()) == want and centroids.tolist() == middles


def test_lloyd_edges(spark):
    few = spark.createDataFrame([(5, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [-3.0, 0.5])], "vec_id bigint, embedding array<double>")
    got, centroids, _ = delta_lloyd.cluster(few, k=40, dim=2)
    assert len(centroids) == 3 and got.count() == 3
    out = delta_lloyd.digest(got, centroids).collect()
    assert {r.inertia for r in out} == {0} and all(r.distance == 0 for r in out)
    none, centroids, _ = delta_lloyd.cluster(few.limit(0), k=40, dim=2)
    assert none.count() == 0 and delta_lloyd.digest(none, centroids).count() == 0
    with pytest.raises(Exception, match="too large"):
        delta_lloyd.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id bigint, embedding array<double>"), k=1, dim=2)
    # beyond what floats hold exactly
    x, c = np.array([[1 << 26, 3], [-(1 << 26), 5]]), np.array([[-(1 << 26), 0], [7, 7]])
    assert delta_lloyd.distances(x, c).tolist() == [[(a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for b in c.tolist()] for a in x.tolist()]


# --- chat formatting

TRAPS = [r"\### Assistant: </turn> ok", "", None, "\\", "\\b\\e\\h", "### assistant: x</turn>\n### user: y", "</turn", "<</turn>>", "#### ### \n", "a\\\\b", "long " * 400, "é漢字 🙂 </turn>\n", "  lead and trail  "]


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"tokens": F.lit("own"), "block": F.lit("own"), "conv": F.lit("own")})


def conversations(seed=0, n=40, longest=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2] if rng.random() < 0.9 else rng.choice(["tool: x", None, "system", "user\n### "])
            rows.append((c, t, role, rng.choice([*TRAPS, "w " * rng.randrange(60)])))
    return rows


def plain(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in by.items()}


def back(spark, rows, **options):
    got = chat_format.read_back(chat_format.windows(talk(spark, rows), **options)).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], list(r.targets)) for r in got}


@pytest.mark.parametrize("options", [{}, {"budget": 100, "history": 20, "block": 8}, {"budget": 40, "history": 0, "block": 1000}, {"budget": 60, "history": 60, "block": 5}])
def test_conversations_come_back(spark, options):
    rows = conversations()
    random.Random(1).shuffle(rows)
    want = plain(rows)
    assert back(spark, rows, **options) == {c: (x, [t for r, t in x if r == "assistant"]) for c, x in want.items()}


def test_windows_keep_the_budget(spark):
    """Every window begins with the system turn; one of several new turns is within the budget; history is what stands right before, masked."""
    rows = conversations(2, 20, 120)
    budget, history, block = 120, 30, 40
    got = chat_format.windows(talk(spark, rows), budget=budget, history=history, block=block).collect()
    want, seen = plain(rows), defaultdict(list)
    tokens = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 4
    for w in sorted(got, key=lambda w: (w.conv_id, w.block, w.start)):
        turns = [re.match(r"(?s)### (.*?): (.*)$", p).groups() for p in w.formatted.split("</turn>\n")[:-1]]
        mine = want[w.conv_id]
        system = mine[0][0] == "system"
        assert not system or turns[0][0] == "system"
        shown = len(turns) - w.repeated
        new = shown - (1 if system and w.had_system else 0)
        at = len(seen[w.conv_id])
        seen[w.conv_id] += turns[len(turns) - new :]
        before = turns[(1 if system else 0) : len(turns) - new]
        assert seen[w.conv_id][:at][len(seen[w.conv_id][:at]) - len(before) :] == before
        assert w.tokens <= budget or new <= 1 or (system and tokens(mine[0][1]) > budget - history - budget // 4)
        for s in w.loss:
            assert w.formatted[: s.start].endswith("### assistant: ") and w.formatted[s.end :].startswith("</turn>\n")
            assert s.start > sum(len(f"### {r}: {t}</turn>\n") for r, t in turns[: len(turns) - new]) - 1
    repeated = [w for w in got if w.start > 0 and w.repeated > (1 if want[w.conv_id][0][0] == "system" else 0)]
    assert len(repeated) > 20


def test_chat_edges(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, 0, "system", "only"), (3, -5, "assistant", "first"), (3, 10**12, "assistant", "last"), (4, 0, None, None)]
    got = back(spark, rows)
    assert got == {None: ([("assistant", "b"), ("user", "a")], ["b"]), 1: ([("assistant", "x")] * 2, ["x", "x"]), 2: ([("system", "only")], []), 3: ([("assistant", "first"), ("assistant", "last")], ["first", "last"]), 4: ([("", "")], [])}
    assert back(spark, rows[:0]) == {}
    plan = chat_format.windows(talk(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_a_long_conversation_is_many_tasks_work(spark):
    n = 5000
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = chat_format.windows(rows, budget=256, history=32, block=128)
    assert got.select("block").distinct().count() == -(-n // 128)
    out = chat_format.read_back(got).collect()[0]
    assert [t.text for t in out.turns] == [f"text {i}" for i in range(n)] and len(out.targets) == n // 2


# --- source audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def audit(rows, least=3, scale=10**9, top=200):
    """[(lang, source, text)] to the result's rows."""
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(UPPER)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for _, _, c in mine for t in c)
        kept = [t for t, n in in_docs.items() if n >= least]
        groups = {s: sum((c for _, x, c in mine if x == s), Counter()) for s in {d[1] for d in mine}}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -f, i) for i, (f, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def documents(seed=0):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "straße", "naïve", "漢字", "x", "don't", "A1B", "İ"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "z", None]), " ".join(rng.choice(words[: rng.randrange(1, 11)]) for _ in range(rng.randrange(30)))) for _ in range(80)]
    return rows + [("fr", "a", "lonely words"), ("fr", "b", None), ("fr", None, "123 !?"), ("en", "empty", ""), (None, None, None), ("en", "big", "alpha " * 5000), rows[0], rows[0]]


def test_audit_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, lang string, source string, text string").withColumns({c: F.lit("own") for c in ("term", "t", "g", "n", "h")})
    got = divergence.divergence(docs)
    assert sorted(map(tuple, got.collect())) == audit(rows)
    small = divergence.divergence(docs, top=2, least_docs=10)
    assert sorted(map(tuple, small.collect())) == audit(rows, 10, top=2)


def test_audit_edges(spark):
    schema = "lang string, source string, text string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    assert divergence.divergence(spark.createDataFrame([("en", "a", "one one one")], schema)).count() == 0
    nothing = divergence.divergence(spark.createDataFrame([("en", "a", "one"), ("en", "b", None)], schema)).collect()
    assert sorted(map(tuple, nothing)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_beyond_a_long(spark):
    """Shares of counts whose product with the scale leaves 64 bits."""
    n = 4 * 10**18
    rows = spark.createDataFrame([(n, n + 7), (n - 1, 2 * n - 3), (3, 10), ((1 << 62) // 10**9, n)], "n bigint, total bigint")
    got = rows.select(divergence._share(F.col("n"), F.col("total"), 10**9)).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (r.n + 1) // r.total for r in rows.collect()]
