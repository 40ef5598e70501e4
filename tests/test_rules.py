"""Rules over small tables: claims, plans, relationships, hierarchies, names, values and what pages show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestry.functions import display as D
from attestry.functions import names as N
from attestry.functions import values as V
from attestry.operators import claims as C
from attestry.operators import hierarchy as Y
from attestry.operators import history as H
from attestry.operators import lifecycle as Z
from attestry.operators import loads as L
from attestry.operators import quality as Q
from attestry.operators import resolve as R
from attestry.plans.specs import EntitySpec, FieldSpec, RelationshipSpec

MODEL = EntitySpec("model", (FieldSpec("name"), FieldSpec("slug"), FieldSpec("year", "int", least=1800, most=2100), FieldSpec("kind", choices=("em", "ss")), FieldSpec("maker", target="maker")))
MAKER = EntitySpec("maker", (FieldSpec("slug", preserve=True),), extra=True)
CREDIT = RelationshipSpec("credit", ("model",), {"person": "string", "role": "string"}, {"count": "int"})


def test_numbers_are_dense(spark):
    rows = spark.range(500_000).select((F.col("id") * 7919 % 500_009).alias("k"), F.concat(F.lit("t"), (F.col("id") % 13).cast("string")).alias("t"), F.col("id").alias("extra"))
    out = C.numbered(rows, ["t", "k"])
    got = out.agg(F.count("number").alias("n"), F.countDistinct("number").alias("d"), F.min("number").alias("low"), F.max("number").alias("high")).first()
    assert tuple(got) == (500_000, 500_000, 1, 500_000)
    first = out.orderBy("number").limit(50).collect()
    assert [(r["t"], r["k"]) for r in first] == [(r["t"], r["k"]) for r in rows.orderBy("t", "k").limit(50).collect()]


def test_classes_and_rejections(spark):
    key, value = "credit|person:ann|role:art", '{"exists":true,"person":"ann","role":"art"}'
    rows = [
        (1, "model", "name", "name", "Star", "direct", None), (2, "model", "year", "year", "1700", "direct", "below minimum"), (3, "model", "year", "year", "x", "direct", "type"), (4, "model", "kind", "kind", "tv", "direct", "choice"),
        (5, "model", "slug", "slug", "No Slug", "direct", "slug form"), (6, "model", "name", "name", "   ", "direct", "blank"), (7, "model", "color", "color", "red", "unrecognized", "unrecognized field"), (8, "maker", "color", "color", "red", "extra", None),
        (9, "model", "credit", key, value, "relationship", None), (10, "maker", "credit", key, value, "extra", None), (11, "model", "credit", key, "[1]", "relationship", "not an object"),
        (12, "model", "credit", key, '{"person":"ann","role":"art"}', "relationship", "exists"), (13, "model", "credit", key, '{"exists":true,"person":"ann"}', "relationship", "missing role"),
        (14, "model", "credit", key, '{"exists":true,"person":1,"role":"art"}', "relationship", "type of person"), (15, "model", "credit", key, '{"exists":true,"person":"ann","role":"art","x":1}', "relationship", "unknown key"),
        (16, "model", "credit", "credit|person:bob|role:art", value, "relationship", "key"), (17, "model", "credit", key, '{"exists":true,"person":"ann","role":"art","count":true}', "relationship", "type of count"),
        (18, "model", "credit", key, '{"exists":1,"person":"ann","role":"art"}', "relationship", "exists"),
    ]
    claims = spark.createDataFrame([r[:5] for r in rows], "claim_id int, entity_type string, field_name string, claim_key string, value string").withColumn("entity_id", F.lit(1))
    got = {r["claim_id"]: (r["claim_class"], r["reject_reason"]) for r in C.validated(claims, [MODEL, MAKER], [CREDIT]).collect()}
    assert got == {r[0]: (r[5], r[6]) for r in rows}
    assert MODEL.constraints() == {"year": {"min": 1800, "max": 2100, "step": 1}}


def test_missing_targets(spark):
    rows = [(1, '{"exists":true,"person":"ann"}'), (2, '{"exists":true,"person":"zed"}'), (3, '{"exists":false,"person":"zed"}'), (4, '{"person":"zed"}')]
    claims = spark.createDataFrame(rows, "claim_id int, value string")
    people = spark.createDataFrame([("ann",)], "slug string")
    assert sorted(r["claim_id"] for r in C.missing_targets(claims, F.get_json_object("value", "$.person"), people, "slug").collect()) == [2, 4]


def claims_of(spark, rows):
    names = "claim_id bigint, entity_type string, entity_id bigint, source_id bigint, field_name string, claim_key string, value string, citation string, needs_review boolean, needs_review_notes string, license_id int, is_active boolean, retracted_by_changeset_id bigint"
    return spark.createDataFrame([(i, "model", e, s, k, k, v, "", False, "", None, a, None) for i, e, s, k, v, a in rows], names)


def test_apply_sweep_and_retract(spark):
    have = claims_of(spark, [(1, 1, 5, "name", "Star", True), (2, 1, 5, "year", "1980", True), (3, 2, 5, "name", "Moon", True), (4, 1, 6, "name", "Other", True), (5, 3, 5, "name", "Far", True)])
    said = claims_of(spark, [(0, 1, 5, "name", "Star", True), (0, 2, 5, "name", "Luna", True), (0, 2, 5, "kind", "em", True)]).drop("claim_id", "is_active", "source_id").withColumn("seq", F.lit(1))
    after, counts = C.applied(have, said, 5, sweep=["name", "year"])
    live = {(r["entity_id"], r["source_id"], r["claim_key"]): (r["claim_id"], r["value"]) for r in after.filter("is_active").collect()}
    assert live == {(1, 5, "name"): (1, "Star"), (2, 5, "kind"): (6, "em"), (2, 5, "name"): (7, "Luna"), (1, 6, "name"): (4, "Other"), (3, 5, "name"): (5, "Far")}
    assert {r["action"]: r["n"] for r in counts.collect()} == {"unchanged": 1, "supersede": 1, "create": 1, "sweep": 1}
    again, counts = C.applied(after, said, 5, sweep=["name", "year"])
    assert again.count() == after.count() and {r["action"]: r["n"] for r in counts.collect()} == {"unchanged": 3}
    empty, _ = C.applied(have, said, 5, sweep=["name"], scope=have.limit(0))
    assert empty.filter("is_active AND claim_id = 5").count() == 1
    targets = spark.createDataFrame([("model", 1, "name", 5), ("model", 9, "name", 5)], "entity_type string, entity_id bigint, claim_key string, source_id bigint")
    closed, missing = C.retracted(have, targets, 77)
    assert {r["claim_id"]: r["retracted_by_changeset_id"] for r in closed.filter("NOT is_active").collect()} == {1: 77}
    assert [r["entity_id"] for r in missing.collect()] == [9]


def test_plans(spark):
    entities = spark.createDataFrame([("a", 1, []), ("b", 2, ["a"]), ("c", 3, ["d"]), ("d", 4, []), ("a", 5, [])], "handle string, seq int, refs array<string>")
    asserted = spark.createDataFrame([("a", None, []), (None, 7, ["b", "zz"]), ("b", 8, []), (None, None, [])], "handle string, entity_id bigint, refs array<string>")
    faults = {(r["fault"], r["handle"]) for r in C.plan_faults(entities, asserted).collect()}
    assert faults == {("duplicate handle", "a"), ("unknown handle", "zz"), ("needs one of handle and entity", "b"), ("needs one of handle and entity", None), ("refers to what is not made yet", "c")}
    plan = spark.createDataFrame([("b", 2), ("a", 1)], "handle string, seq int")
    got = {r["handle"]: r["entity_id"] for r in C.with_handles(asserted.filter("handle = 'a' OR entity_id = 7"), plan, 100).collect()}
    assert got == {"a": 100, None: 7}


def test_unpivot(spark):
    rows = spark.createDataFrame([(1, "Star", 1980, ""), (2, None, 1990, "x")], "id int, name string, year int, note string")
    assert sorted(map(tuple, C.unpivoted(rows, "id", ["name", "year", "note"]).collect())) == [(1, "name", "Star"), (1, "year", "1980"), (2, "note", "x"), (2, "year", "1990")]


def test_relationships(spark):
    rows = [("model", 1, "credit", '{"exists":true,"person":"ann","count":2}'), ("model", 1, "credit", '{"exists":true,"person":"ann","count":2}'), ("model", 2, "credit", '{"exists":false,"person":"bob"}'), ("model", 3, "other", '{"person":"cy"}')]
    won = spark.createDataFrame(rows, "entity_type string, entity_id int, field_name string, value string")
    assert [tuple(r) for r in R.related(won, "credit", {"person": "string", "count": "int"}).collect()] == [("model", 1, "ann", 2)] * 2
    assert R.related_any(won, "credit", {"person": "string"}).count() == 1
    alias = spark.createDataFrame([("model", 1, "alias", '{"alias":"star two","display":"Star Two"}'), ("model", 1, "alias", '{"alias":"s2","display":"S2"}')], "entity_type string, entity_id int, field_name string, value string")
    before = spark.createDataFrame([(1, "STAR TWO"), (1, "Gone"), (1, "S2")], "entity_id int, display string")
    assert {(r["alias"], r["display"], r["action"]) for r in R.aliases_of(alias, before).collect()} == {("star two", "Star Two", "update"), ("gone", "Gone", "delete"), ("s2", "S2", "keep")}


def test_resolution_order_and_checks(spark):
    assert [s.name for s in R.in_dependency_order([MODEL, MAKER])] == ["maker", "model"]
    with pytest.raises(ValueError):
        R.in_dependency_order([EntitySpec("a", (FieldSpec("x", target="b"),)), EntitySpec("b", (FieldSpec("y", target="a"),))])
    rows = spark.createDataFrame([(1, 1990, 1980), (2, 1980, 1990), (3, None, 1990)], "id int, began int, ended int")
    assert [(r["id"], r["broken"]) for r in R.unclaimed_check(rows, {"order": "began <= ended"}).collect()] == [(1, "order")]
    assert [r[0] for r in spark.createDataFrame([(1,), (5,), (None,)], "r int").select(R.displayable(F.col("r"), 3)).collect()] == [False, True, True]


def test_hierarchies(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("e", "c"), ("y", "x")]
    paths = Y.closure(spark.createDataFrame(edges, "child string, parent string"))
    want = {(p, c) for p in "abcd" for c in "abcde"} | {("x", "y"), ("e", "e"), ("x", "x"), ("y", "y")}
    assert {tuple(r) for r in paths.collect()} == want
    docs = spark.createDataFrame([(1, ["y"]), (2, []), (3, ["q"])], "id int, terms array<string>")
    assert {r["id"]: r["terms"] for r in Y.expanded(docs, "id", "terms", paths).collect()} == {1: ["x", "y"], 2: [], 3: ["q"]}
    pairs = [("us", "us/il"), ("us/il", "us"), ("us", "usa"), ("us/il", "us/il"), ("us/il", "us/ny")]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(Y.compatible(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False]
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id int, parent int")
    assert sorted(r["id"] for r in Y.long_chains(chain, "id", "parent").collect()) == [3, 4]


def test_history(spark):
    cites = spark.createDataFrame([(1, "p. 3"), (2, "p. 4")], "citation_id int, locator string")
    assert H.names_of(x=cites.select(F.col("citation_id").alias("entity_id"), F.col("locator").alias("name"))).count() == 2


def test_names(spark):
    rows = ["Thé  Björk & Co.", "Straße (1990)", "Ａｂｃ", "The Ünder-Ground!"]
    got = spark.createDataFrame([(r,) for r in rows], "n string").select(N.search_form(F.col("n")), N.collision_form(F.col("n")), N.base_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["the bjork co", "straße 1990", "ａｂｃ", "the underground"]
    assert got[1][1] == "strasse 1990" and got[2][1] == "abc" and got[1][2] == "Straße"


def test_values(spark):
    lines = ["Acme Company, of Chicago, Illinois (1930-1999) [Trade Name: Ac]", "Solo", "Acme (1950-present)", "Acme, of Paris", None, "Co. [Trade Name: X Y]", "Half (not years), of Rome"]
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(V.company_line(F.col("l")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [
        ("Acme Company", "Ac", "1930-1999", "Chicago, Illinois"), ("Solo", "", "", ""), ("Acme", "", "1950-present", ""), ("Acme", "", "", "Paris"), ("", "", "", ""), ("Co.", "X Y", "", ""), ("Half (not years)", "", "", "Rome"),
    ]
    assert spark.createDataFrame([("a &amp; b &eacute;",)], "t string").select(V.unescaped(F.col("t"))).first()[0] == "a & b é"


def test_images(spark):
    schema = "id int, uploads array<struct<category:string,url:string,rank:int>>, images array<struct<primary:boolean,large:string,medium:string,small:string,rank:int>>, urls array<string>"
    up = [("other", "http://o", 6), ("backglass", "http://b", 6)]
    rows = [
        (1, up, None, None, "http://b"), (2, [("backglass", "http://b", 1), ("other", "https://o", None)], None, None, "https://o"), (3, [("other", "/local", 9)], [(False, "http://1", None, None, 9), (True, None, "http://2", "http://3", None)], None, "http://2"),
        (4, None, [(None, None, None, "http://s", 4)], ["http://u"], "http://s"), (5, [], [(True, "x", None, None, 9)], [None, "rel/x", "http://u"], "http://u"), (6, None, None, None, None), (7, None, [(True, "http://x", None, None, 1)], ["http://u"], "http://u"),
    ]
    docs = spark.createDataFrame([r[:4] for r in rows], schema)
    got = {r["id"]: r["u"] for r in docs.select("id", D.chosen_image(F.col("uploads"), F.col("images"), F.coalesce("urls", F.array().cast("array<string>")), 4).alias("u")).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_attribution(spark):
    rows = spark.createDataFrame([(1, "a", 1, "b", 9), (2, None, 9, "b", None), (3, "a", 1, "b", 2)], "id int, a string, ra int, b string, rb int")
    got = {r["id"]: r["x"] and tuple(r["x"]) for r in rows.select("id", D.attribution([(F.col("a"), F.lit("CC"), F.col("ra")), (F.col("b"), F.lit("PD"), F.col("rb"))], 5).alias("x")).collect()}
    assert got == {1: ("b", "PD"), 2: ("b", "PD"), 3: None}
    won = spark.createDataFrame([("model", 1, "description", "text", 3, 8), ("model", 2, "name", "x", 3, 8), ("model", 4, "description", "t", None, None)], "entity_type string, entity_id int, field_name string, value string, source_id int, effective_license_id int")
    licenses, sources = spark.createDataFrame([(8, "CC", 6)], "license_id int, name string, rank int"), spark.createDataFrame([(3, "wiki")], "source_id int, slug string")
    assert sorted((r["entity_id"], r["source"], r["license"], r["rank"]) for r in D.text_attribution(won, licenses, sources).collect()) == [(1, "wiki", "CC", 6), (4, None, None, None)]


def test_shown_values(spark):
    dates = [(30, "just now"), (90, "1 minute ago"), (7300, "2 hours ago"), (86_400 * 3, "3 days ago"), (86_400 * 20, "Jun 10"), (86_400 * 400, "May 27, 2023")]
    now = F.to_timestamp(F.lit("2024-06-30 12:00:00"))
    rows = spark.createDataFrame(dates, "ago int, want string").withColumn("at", F.timestamp_seconds(F.unix_timestamp(now) - F.col("ago")))
    assert [r[0] for r in rows.select(D.relative_date(F.col("at"), now)).collect()] == [w for _, w in dates]
    diff = spark.createDataFrame([("a b c", "a x c d"), (None, "n"), ("same", "same")], "o string, n string").select(D.word_diff("o", "n").alias("d")).collect()
    assert [[(x["op"], x["text"]) for x in r["d"]] for r in diff] == [[("same", "a"), ("del", "b"), ("ins", "x"), ("same", "c"), ("ins", "d")], [("ins", "n")], [("same", "same")]]
    same = spark.createDataFrame([('{"a":1,"b":[1,2]}', '{"b": [1, 2], "a": 1}'), ('{"a":1}', '{"a":true}'), ("[1,2]", "[2,1]"), ("x", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in same.select(D.same_json(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, True]
    over = spark.createDataFrame([("k",), ("z",), (None,)], "v string").select(D.overridden(F.col("v"), {"k": "fixed"}, F.lit("else")))
    assert [r[0] for r in over.collect()] == ["fixed", "else", "else"]
    state = {"maker": ["ac"], "year": (1980, None), "q": "", "players": [2, 4], "span": (1, 3)}
    assert D.filter_labels(state, {"maker": {"ac": "Acme"}}) == [("maker", "ac", "Acme"), ("year", "1980-", "from 1980"), ("players", "2", "2"), ("players", "4", "4"), ("span", "1-3", "1 – 3")]


def test_writes(spark):
    have = spark.createDataFrame([("t1", "star", "The Star"), ("t2", "moon", "Moon")], "title string, slug string, name string")
    new = spark.createDataFrame([("t1", "star-2", "STAR!"), ("t2", "star", "Other"), ("t3", "ok", "Moon"), ("t4", "x", "Twin"), ("t4", "y", "twin"), ("t5", "z", "!!")], "title string, slug string, name string")
    assert {tuple(r) for r in Z.creation_faults(new, have, ["title"]).collect()} == {("star-2", "name taken"), ("star", "slug taken"), ("x", "name given twice"), ("y", "name given twice"), ("z", "no name")}
    media = spark.createDataFrame([("model", 1, 5, "backglass", True), ("model", 1, 6, "poem", False)], "entity_type string, entity_id int, asset_id int, category string, is_primary boolean")
    good, bad = Z.media_claims(media, ["backglass"])
    row = good.first()
    assert row["claim_key"] == "media_attachment|category:backglass|media_asset:5" and '"is_primary":true' in row["value"] and [r["asset_id"] for r in bad.collect()] == [6]
    assert '"exists":false' in Z.media_claims(media, ["backglass"], attached=False)[0].first()["value"]
    given = spark.createDataFrame([(1, "Ann"), (1, " ann "), (2, "zed")], "row int, value string")
    assert {tuple(r) for r in Z.input_faults(given, "row", "value", spark.createDataFrame([("ANN",)], "n string"), "n").collect()} == {(1, "ann", "given twice"), (2, "zed", "unknown")}
    joint = Z.joint_changeset(spark.createDataFrame([(1, "own"), (2, None)], "id int, citation string"), 9, "copy").collect()
    assert [(r["changeset_id"], r["citation"]) for r in joint] == [(9, "own"), (9, "copy")]
    assert Z.metadata(spark, [MODEL], {"model": ["backglass"]}).count() == 5


def test_loads_refuse(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, parent string")
    parents = spark.createDataFrame([(10, "a")], "id int, slug string")
    kept, lost = L.with_parent(rows, parents, "parent", "slug", "id")
    assert {(r["parent"], r["parent_id"]) for r in kept.collect()} == {("a", 10), (None, None)} and [tuple(r) for r in lost.collect()] == [("missing parent", "zz")]
    with pytest.raises(L.LoadError, match="zz"):
        L.with_parent(rows, parents, "parent", "slug", "id", must=True)


def test_checks_of_claims(spark):
    rows = [("model", 1, 1, "name", "name", "Ace", True), ("model", 2, 2, "name", "name", "Bee", True), ("model", 3, 1, "name", "name", "Cue", False), ("gone", 9, 1, "name", "name", "x", True), ("gone", 9, 2, "name", "name", "y", True),
            ("model", 1, 1, "maker", "maker", "acme", True), ("model", 2, 1, "maker", "maker", "nobody", True), ("model", 4, 1, "maker", "maker", " ", True), ("model", 5, 1, "maker", "maker", None, True),
            ("model", 1, 1, "credit", "credit|person:7", '{"person":7}', True), ("model", 1, 1, "credit", "credit|person:8", '{"person":8}', True), ("model", 1, 1, "credits", "credits", '{"person":99}', True)]
    claims = spark.createDataFrame(rows, "entity_type string, entity_id bigint, source_id bigint, field_name string, claim_key string, value string, is_active boolean")
    entities = spark.createDataFrame([("model", i) for i in (1, 2, 4, 5)], "entity_type string, entity_id bigint")

    def found(df):
        return sorted(r["subject"] for r in df.collect())

    assert found(Q.orphaned(claims, entities)) == [9]
    assert found(Q.unresolved(claims, "maker", F.col("value"), spark.createDataFrame([("acme",)], "slug string"), "slug")) == ["nobody"]
    person = F.get_json_object("value", "$.person").cast("bigint")
    assert found(Q.unresolved(claims, "credit", person, spark.createDataFrame([(7,)], "id bigint"), "id")) == [8]
    assert found(Q.uncurated(entities, "entity_id", claims, 1, "name")) == [2, 4, 5]
    credits = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 7)], "model bigint, person bigint")
    assert found(Q.unclaimed(credits, ["model", "person"], credits.filter("model = 1"))) == ["2:7"]
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id bigint, of bigint")
    assert found(Q.chained(chain, "id", "of")) == [3] and found(Q.childless(chain, "id", chain, "of")) == [3, 4]
    assert found(Q.flagged(chain, "id", F.col("of") == 99)) == [4]


def test_vocabulary_edges(spark):
    from attestry.operators import vocabulary as V

    lines = spark.createDataFrame([(1, None), (2, ""), (3, "Ramps (3). Flipper (left, right), , Bumper ( 2 )"), (4, "Gate (2).")], "id int, line string")
    got = {r["id"]: [tuple(x) for x in r["parts"]] for r in lines.select("id", V.feature_parts(F.col("line")).alias("parts")).collect()}
    assert got == {1: [], 2: [], 3: [("Ramps", 3), ("Flipper (left, right)", None), ("Bumper ( 2 )", None)], 4: [("Gate", 2)]}
    words = {"reward": spark.createDataFrame([("Multi", "m"), (None, "x")], "term string, slug string"), "cabinet": spark.createDataFrame([("wide", "w"), ("multi", "other")], "term string, slug string")}
    rows = spark.createDataFrame([(1, ["WIDE", "multi", "Wide", None, "Pro", "??", "??", "Multi"]), (2, []), (3, None)], "id int, terms array<string>")
    kept = sorted(tuple(r) for r in V.sorted_terms(rows, "id", "terms", words, ("cabinet",), ("Pro",)).collect())
    assert sorted(x[:3] for x in kept) == [(1, 1, "multi"), (1, 2, "Wide"), (1, 5, "??"), (1, 6, "??")]
    assert {x[1]: x[3:] for x in kept} == {1: ("reward", "m"), 2: ("cabinet", "w"), 5: (None, None), 6: (None, None)}
    texts = spark.createDataFrame([(1, None), (2, "plain [[no link"), (3, "[[a:1]][[a:9]] x [[a:1]]")], "id int, text string")
    targets = spark.createDataFrame([("a", "1", "  a [b]  c ", "/u")], "type string, ref string, label string, url string")
    shown = {r["id"]: (r["text"], r["n_links"]) for r in V.rendered_links(texts, "id", "text", targets).collect()}
    assert shown == {1: (None, 0), 2: ("plain [[no link", 0), 3: ("[a b c](/u)[broken link] x [a b c](/u)", 3)}


def test_garbled_claims_are_refused(spark):
    rows = [(1, "name", "CafÃ©"), (2, "name", "Café"), (3, "name", "plain"), (4, "slug", "a"), (5, "name", "bad �"), (6, "year", "1980")]
    claims = spark.createDataFrame([(i, "model", f, f, v) for i, f, v in rows], "claim_id int, entity_type string, field_name string, claim_key string, value string").withColumn("entity_id", F.lit(1))
    assert {r["claim_id"]: r["reject_reason"] for r in C.validated(claims, [MODEL, MAKER], [CREDIT]).collect()} == {1: "garbled", 2: None, 3: None, 4: None, 5: "garbled", 6: None}


def test_primary_faults(spark):
    media = spark.createDataFrame([("m", 1, "front", 5, True), ("m", 1, "front", 6, None), ("m", 2, "front", 7, False)], "entity_type string, entity_id int, category string, asset_id int, is_primary boolean")
    chosen = spark.createDataFrame([("m", 1, "front", 6), ("m", 2, "back", 7), ("m", 2, "front", 7)], "entity_type string, entity_id int, category string, asset_id int")
    claims, faults = Z.primary_claims(media, chosen)
    assert {(r.entity_id, "true" in r.value.split("is_primary")[1]) for r in claims.collect()} == {(1, True), (1, False), (2, True)} and claims.count() == 3
    assert [(r.entity_id, r.category) for r in faults.collect()] == [(2, "back")]


def test_slugs_take_the_free_numbers(spark):
    """Random bases and taken slugs, one base with most of the rows, against counting up."""
    import random

    from attestry.operators import matching as M

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c-2", "d"])) for i in range(400)]
    taken = {rng.choice(["a", "b", "c", "d", "e"]) + rng.choice(["", f"-{rng.randrange(300)}"]) for _ in range(300)} | {"c-2", "c-2-2", "d-0", "d-x"}
    got = M.unique_slugs(spark.createDataFrame(rows, "id int, base string"), "base", "id", spark.createDataFrame([(t,) for t in taken], "slug string"))
    have, want = set(taken), {}
    for i, base in rows:
        n = 1
        while (base if n == 1 else f"{base}-{n}") in have:
            n += 1
        want[i] = base if n == 1 else f"{base}-{n}"
        have.add(want[i])
    assert {r.id: r.slug for r in got.collect()} == want and got.columns == ["id", "base", "slug"]
    assert {r.slug for r in M.unique_slugs(spark.createDataFrame([(1, "x")], "id int, base string"), "base", "id", spark.createDataFrame([], "slug string")).collect()} == {"x"}
