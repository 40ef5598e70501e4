"""Streams against their batch forms."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attestry.operators.resolve import winners
from attestry.streaming import jobs as J


def brute(times, limit, seconds):
    kept, out = [], []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        if len(kept) < limit:
            kept.append(t)
            out.append((True, None))
        else:
            out.append((False, kept[0] + seconds - t))
    return out


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def files(spark, tmp_path, rows, schema, parts):
    """``rows`` as one Parquet file a part, read as a stream of one file a batch."""
    folder = f"file://{tmp_path}/in"
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def requests(n=300, users=4):
    rng = random.Random(5)
    at = sorted(rng.randrange(3000) for _ in range(n))
    return [(i, rng.randrange(users) if i % 3 else 0, t) for i, t in enumerate(at)]


def test_rate_limits(spark):
    rows = requests()
    docs = spark.createDataFrame(rows, "id bigint, user bigint, s bigint").withColumn("at", F.timestamp_seconds("s"))
    got = {(r["user"], r["id"]): (r["allowed"], r["retry_after"]) for r in J.rate_limited(docs, "user", "at", "id", 5, 60).collect()}
    want = {}
    for user in range(4):
        mine = [(i, t) for i, u, t in rows if u == user]
        want |= {(user, i): x for (i, _), x in zip(mine, brute([t for _, t in mine], 5, 60), strict=True)}
    assert got == want and any(not a for a, _ in got.values()) and len(got) == len(rows)


def test_rate_limit_stream(spark, tmp_path):
    """Batches in time order decide as one batch of all requests does."""
    rows = requests(90)
    folder = f"file://{tmp_path}/in"
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], "id bigint, user bigint, s bigint").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id bigint, user bigint, s bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r["user"], r["id"]): (r["allowed"], r["retry_after"]) for r in run(J.rate_limit_stream(stream, "user", "at", "id", 5, 60), "append", "limits")}
    docs = spark.read.parquet(folder)
    assert got == {(r["user"], r["id"]): (r["allowed"], r["retry_after"]) for r in J.rate_limited(docs, "user", "at", "id", 5, 60).collect()}


def test_late_windows(spark, tmp_path):
    """Windows that are closed by the watermark hold what the batch form counts."""
    rows = [(60 * i + i % 7, "ab"[i % 2], float(i)) for i in range(120)]
    folder = f"file://{tmp_path}/in"
    for i in range(4):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], "s bigint, kind string, value double").withColumn("at", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("s bigint, kind string, value double, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    got = {(r["w"]["start"], r["kind"]): (r["n"], r["total"]) for r in run(J.late_window_counts(stream, "at", "kind"), "append", "late")}
    batch = spark.read.parquet(folder).groupBy(F.window("at", "5 minutes", "1 minute").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()
    want = {(r["w"]["start"], r["kind"]): (r["n"], r["total"]) for r in batch}
    assert len(got) > 100 and all(want[k] == v for k, v in got.items())


def test_incremental_resolution(spark, tmp_path):
    """After every batch the latest winners are those of all claims so far."""
    schema = "claim_id bigint, entity_type string, entity_id bigint, claim_key string, priority int, created_at timestamp, value string"
    rng = random.Random(2)
    rows = [(i, "x", rng.randrange(5), rng.choice("ab"), rng.randrange(3), i, f"v{i}") for i in range(40)]
    folder = f"file://{tmp_path}/in"
    for i in range(4):
        part = spark.createDataFrame(rows[10 * i : 10 * i + 10], "claim_id bigint, entity_type string, entity_id bigint, claim_key string, priority int, s bigint, value string")
        part.withColumn("created_at", F.timestamp_seconds("s")).select(*[c.split(" ")[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = J.resolve_incrementally(stream, f"file://{tmp_path}/claims", f"file://{tmp_path}/won", f"file://{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    got = {(r["entity_id"], r["claim_key"]): r["claim_id"] for r in J.latest(spark.read.parquet(f"file://{tmp_path}/won")).collect()}
    want = {(r["entity_id"], r["claim_key"]): r["claim_id"] for r in winners(spark.read.parquet(folder)).collect()}
    assert got == want and len({c for c in got.values()}) == len(got)


def fold(rows, limit, seconds):
    """Decisions by the plain rule, rows (id, user, second, good) in the order of arrival."""
    counters, out = {}, {}
    for i, user, t, good in rows:
        begin, used = counters.get(user, (None, 0))
        if begin is None or t >= begin + seconds:
            begin, used = t, 0
        out[user, i] = (begin * 1_000_000, used, used < limit)
        counters[user] = (begin, used + (1 if used < limit and good else 0))
    return out


REQUESTS = "id bigint, user bigint, s bigint, good boolean"


def decided(rows):
    return {(r["user"], r["id"]): (r["window_start"], r["used"], r["allowed"]) for r in rows}


def test_counter(spark):
    """Windows begin with the first request of each user; equal times go by id; refused and failed requests don't count."""
    rows = [(i, u, t, (i * 7) % 5 != 0) for i, u, t in requests(400)]
    rows += [(1000 + i, 9, 50, True) for i in range(6)] + [(1010, 9, 109, True), (1011, 9, 110, True)]
    events = spark.createDataFrame(rows, REQUESTS).withColumn("at", F.timestamp_seconds("s"))
    got = decided(J.counted(events, "user", "at", "id", 4, 60, "good").collect())
    assert got == fold(sorted(rows, key=lambda r: (r[2], r[0])), 4, 60)
    assert got[9, 1010] == (50_000_000, 4, False) and got[9, 1011] == (110_000_000, 0, True)


def test_counter_stream(spark, tmp_path):
    """A stream decides as the rows arrive; late rows are judged by the counter as it stands, and those behind the watermark not at all."""
    rng = random.Random(8)
    batches = []
    for b in range(4):
        rows = [(100 * b + i, rng.randrange(3), 200 * b + rng.randrange(200), rng.random() < 0.8) for i in range(40)]
        rows += [(100 * b + 50 + i, 7, 200 * b + 13, True) for i in range(6)]  # equal times
        if b:
            rows.append((100 * b + 90, 7, 200 * b - 20, True))  # late, within the watermark
        batches.append(rows)
    batches[3].append((399, 7, 1, True))  # far too late
    folder = f"file://{tmp_path}/in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, REQUESTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", F.timestamp_seconds("s"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = decided(run(J.counted_stream(stream, "user", "at", "id", 4, 60, "3 minutes", "good"), "append", "counted"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    arrived = [r for rows in batches for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[0] != 399]
    assert got == fold(arrived, 4, 60)
