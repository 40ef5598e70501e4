"""Cached payloads: exactly the stale ones are made anew, and equal content keeps its tag."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import payloads as P

T = "timestamp_ntz"


def at(s):
    return F.timestamp_seconds(F.lit(s)).cast(T)


def cache(spark):
    rows = [(1, '{"n":1}', 100), (2, '{"n":2}', 100), (3, '{"n":3}', 100), (4, '{"n":4}', 10), (5, '{"n":5}', 100)]
    payloads = spark.createDataFrame(rows, "payload_id int, payload string, s bigint").select("payload_id", "payload", F.md5("payload").alias("etag"), F.timestamp_seconds("s").cast(T).alias("made_at"))
    parts = spark.createDataFrame([(1, "game", 1), (1, "maker", 7), (2, "game", 2), (2, "maker", 7), (3, "game", 3), (3, "maker", 8), (4, "game", 4), (5, "game", 5)], "payload_id int, entity_type string, entity_id int")
    return payloads, parts


def changes(spark, rows):
    return spark.createDataFrame(rows, "entity_type string, entity_id int, s bigint").select("entity_type", "entity_id", F.timestamp_seconds("s").cast(T).alias("at"))


def test_stale(spark):
    payloads, parts = cache(spark)

    def told(rows, now=150, seconds=100):
        return {r.payload_id: r.reason for r in P.stale(payloads, parts, changes(spark, rows), at(now), seconds).collect()}

    assert told([]) == {4: "expired"}
    # at the time it was made is not after; another kind with the same id is another entity; what nothing was made from hits nothing
    assert told([("maker", 7, 101), ("game", 3, 100), ("person", 3, 120), ("maker", 99, 120)]) == {1: "changed", 2: "changed", 4: "expired"}
    assert told([("maker", 7, 50), ("maker", 7, 130), ("game", 4, 130)]) == {1: "changed", 2: "changed", 4: "changed"}
    assert told([(P.ALL, None, 90)]) == {4: "changed"}
    assert set(told([(P.ALL, None, 101)])) == {1, 2, 3, 4, 5}
    assert told([], now=199) == {4: "expired"} and set(told([], now=200)) == {1, 2, 3, 4, 5}


def test_refreshed(spark):
    payloads, parts = cache(spark)
    gone = P.stale(payloads, parts, changes(spark, [("maker", 7, 101)]), at(150), 1000)
    asked = []

    def make(ids):
        asked.append(sorted(r.payload_id for r in ids.collect()))
        text = F.when(F.col("payload_id") == 1, '{"n":1}').otherwise(F.concat(F.lit('{"new":'), F.col("payload_id").cast("string"), F.lit("}")))
        return ids.select("payload_id", text.alias("payload")), ids.select("payload_id", F.lit("game").alias("entity_type"), (F.col("payload_id") + 10).alias("entity_id"))

    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6)], "payload_id int")
    after, index = P.refreshed(payloads, parts, gone, wanted, make, at(150))
    rows, old = {r.payload_id: r for r in after.collect()}, {r.payload_id: r for r in payloads.collect()}
    assert asked == [[1, 2, 6]] and set(rows) == {1, 2, 3, 5, 6}
    assert rows[3] == old[3] and rows[5] == old[5]
    assert rows[1].etag == old[1].etag and rows[1].made_at > old[1].made_at and rows[2].etag != old[2].etag
    assert sorted((r.payload_id, r.entity_type, r.entity_id) for r in index.collect()) == [(1, "game", 11), (2, "game", 12), (3, "game", 3), (3, "maker", 8), (5, "game", 5), (6, "game", 16)]
    # what was made from the new parts is hit by their changes, no longer by the old ones
    later = changes(spark, [("maker", 7, 160), ("game", 12, 160)])
    assert {r.payload_id for r in P.stale(after, index, later, at(170), 1000).collect()} == {2}
