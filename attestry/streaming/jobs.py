"""Streams: incremental resolution of claims, rolling rate limits with state, fixed windows, the change feed."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators._shared import scratch, stored
from ..operators.maintenance import Derived, maintained
from ..operators.resolve import winners
from ..plans.specs import EntitySpec


def decide(at: int, kept: deque[int], limit: int, width: int) -> tuple[bool, int | None]:
    """Allowed or not, and the whole seconds to wait if not. ``kept`` has the allowed times of the window, in microseconds, and is brought
    up to date; refused requests don't count."""
    while kept and kept[0] <= at - width:
        kept.popleft()
    if len(kept) >= limit:
        return False, -((at - kept[0] - width) // 1_000_000)
    kept.append(at)
    return True, None


def rate_limited(events: DataFrame, user: str, at: str, id_: str, limit: int, seconds: int) -> DataFrame:
    """Batch form: (user, id, allowed, retry_after). A user's requests are judged in time order, which only a fold can do: sorted rows are
    streamed and at most ``limit`` times of one user are in memory, however many requests there are."""
    rows = events.select(F.col(user).alias("user"), F.col(id_).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, kept = None, deque()
        for batch in batches:
            out = []
            for name, time in zip(batch["user"], batch["at"].tolist(), strict=True):
                if name != who:
                    who, kept = name, deque()
                out.append(decide(time, kept, limit, seconds * 1_000_000))
            yield pd.DataFrame({"user": batch["user"], "id": batch["id"], "allowed": [a for a, _ in out], "retry_after": pd.array([r for _, r in out], dtype="Int32")})

    kind = rows.schema["user"].dataType.simpleString()
    dealt = rows.repartition("user").sortWithinPartitions("user", "at", "id")
    return dealt.mapInPandas(fold, f"user {kind}, id {rows.schema['id'].dataType.simpleString()}, allowed boolean, retry_after int")


class RateLimiter(StatefulProcessor):
    """Stream form: the allowed times of each user within the window are its state."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(rows)).sort_values(["at", "id"])
        kept = deque(r[0] for r in self.kept.get()) if self.kept.exists() else deque()
        out = [decide(t, kept, self.limit, self.seconds * 1_000_000) for t in group["at"].tolist()]
        self.kept.put([(t,) for t in kept])
        yield pd.DataFrame({"user": [key[0]] * len(group), "id": group["id"].tolist(), "allowed": [a for a, _ in out], "retry_after": pd.array([r for _, r in out], dtype="Int32")})

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, user: str, at: str, id_: str, limit: int, seconds: int) -> DataFrame:
    rows = events.select(F.col(user).alias("user"), F.col(id_).alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"))
    schema = f"user {rows.schema['user'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, allowed boolean, retry_after int"
    return rows.groupBy("user").transformWithStateInPandas(statefulProcessor=RateLimiter(limit, seconds), outputStructType=schema, outputMode="append", timeMode="none")


def count_in(at: int, counter: tuple[int, int] | None, limit: int, width: int, good: bool = True) -> tuple[bool, tuple[int, int]]:
    """Allowed or not, and the counter (begin of its window, requests that counted) afterwards. A window begins with the first request after the one before
    has run out, so that each user's are their own; refused requests and those that come to nothing (not ``good``) don't count. A request from before
    the window's begin, late, is judged by the counter as it stands."""
    if counter is None or at >= counter[0] + width:
        counter = (at, 0)
    begin, used = counter
    return used < limit, (begin, used + (used < limit and good))


def _requests(events: DataFrame, user: str, at: str, id_: str, good: str | None) -> DataFrame:
    time = F.unix_micros(F.col(at).cast("timestamp"))
    return events.select(F.col(user).alias("user"), F.col(id_).alias("id"), time.alias("at"), (F.col(good) if good else F.lit(True)).alias("good"))


def _decisions(rows: DataFrame) -> str:
    return f"user {rows.schema['user'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, window_start bigint, used int, allowed boolean"


def counted(events: DataFrame, user: str, at: str, id_: str, limit: int, seconds: int, good: str | None = None) -> DataFrame:
    """Batch form of a counter with a time to live: (user, id, window_start in microseconds, used before the request, allowed). A user's requests are judged in
    the order of time and id; sorted rows are streamed, and one counter is in memory."""
    rows = _requests(events, user, at, id_, good)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, counter = None, None
        for batch in batches:
            out = []
            for name, time, fine in zip(batch["user"], batch["at"].tolist(), batch["good"].tolist(), strict=True):
                if name != who:
                    who, counter = name, None
                allowed, after = count_in(time, counter, limit, seconds * 1_000_000, fine)
                out.append((after[0], after[1] - (allowed and fine), allowed))
                counter = after
            yield pd.DataFrame({"user": batch["user"], "id": batch["id"], "window_start": [w for w, _, _ in out], "used": [u for _, u, _ in out], "allowed": [a for _, _, a in out]})

    return rows.repartition("user").sortWithinPartitions("user", "at", "id").mapInPandas(fold, _decisions(rows))


class Counter(StatefulProcessor):
    """Stream form: one counter a user, dropped by a timer when the watermark has passed the end of its window."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.width = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "begin bigint, used int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = pd.concat(list(rows)).sort_values(["at", "id"])
        counter = before = tuple(self.counter.get()) if self.counter.exists() else None
        out = []
        for time, fine in zip(group["at"].tolist(), group["good"].tolist(), strict=True):
            allowed, counter = count_in(time, counter, self.limit, self.width, fine)
            out.append((counter[0], counter[1] - (allowed and fine), allowed))
        self.counter.update(counter)
        if before is None or before[0] != counter[0]:
            if before is not None:
                self.handle.deleteTimer(self.end(before[0]))
            self.handle.registerTimer(self.end(counter[0]))
        yield pd.DataFrame({"user": [key[0]] * len(group), "id": group["id"].tolist(), "window_start": [w for w, _, _ in out], "used": [u for _, u, _ in out], "allowed": [a for _, _, a in out]})

    def end(self, begin: int) -> int:
        return -(-(begin + self.width) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counter.clear()
        yield pd.DataFrame({"user": pd.Series([key[0]])[:0], "id": pd.Series([0])[:0], "window_start": pd.Series([0])[:0], "used": pd.Series([0])[:0], "allowed": pd.Series([True])[:0]})

    def close(self) -> None:
        pass


def counted_stream(events: DataFrame, user: str, at: str, id_: str, limit: int, seconds: int, late: str = "10 minutes", good: str | None = None) -> DataFrame:
    """The same decisions on a stream, whose rows may be ``late``; rows later than that are dropped by the watermark, undecided. Requests are judged as they
    arrive, by time within a micro-batch."""
    rows = _requests(events, user, at, id_, good).withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    return rows.groupBy("user").transformWithStateInPandas(statefulProcessor=Counter(limit, seconds), outputStructType=_decisions(rows), outputMode="append", timeMode="eventTime")


def window_counts(events: DataFrame, user: str, at: str, width: str = "1 hour") -> DataFrame:
    """Requests of each user in fixed windows."""
    return events.groupBy(F.col(user), F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("window_start"), "n")


def late_window_counts(events: DataFrame, at: str, kind: str, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding counts and sums with a watermark, for streams with late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def resolve_incrementally(stream: DataFrame, claims_path: str, winners_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of claims is appended to the log and the winners of the touched keys are computed anew and appended with the batch
    number; the latest row of a key is its winner (:func:`latest`). A batch that is run again writes the same rows under its number."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{claims_path}/batch={number}")
        touched = spark.read.parquet(f"{claims_path}/batch={number}").select("entity_type", "entity_id", "claim_key").distinct()
        log = spark.read.parquet(claims_path).filter(F.col("batch") <= number).drop("batch")
        won = winners(log.join(touched, ["entity_type", "entity_id", "claim_key"], "left_semi"))
        won.write.mode("overwrite").parquet(f"{winners_path}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def latest(won: DataFrame) -> DataFrame:
    """Current winners of a log of winners with batch numbers."""
    rest = [c for c in won.columns if c not in ("entity_type", "entity_id", "claim_key", "batch")]
    g = won.groupBy("entity_type", "entity_id", "claim_key").agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return g.select("entity_type", "entity_id", "claim_key", *[F.col(f"row.{c}") for c in rest])


def maintain_incrementally(stream: DataFrame, root: str, checkpoint: str, specs: list[EntitySpec], derived: list[Derived], priority: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each micro-batch of claims goes to the log under its number; what hangs on the touched claims is computed anew and written, for each kind of entity, as
    the rows that changed under the same number (:func:`current`). ``priority`` makes a log of claims effective. A batch that is run again writes the same."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with scratch():
            batch.write.mode("overwrite").parquet(f"{root}/claims/batch={number}")
            touched = spark.read.parquet(f"{root}/claims/batch={number}").select("entity_type", "entity_id", "field_name").distinct()
            log = spark.read.parquet(f"{root}/claims").filter(F.col("batch") <= number).drop("batch")
            won = stored(winners(priority(log.join(touched.select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_semi"))), "won")
            before = {s.name: current(spark, root, s.name, number - 1) for s in specs}
            for name, table in maintained(won, specs, derived, touched, before).items():
                table.rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table of entities after batch ``number`` (None: the last): the latest row of each. Batch -1 is what there was before the stream."""
    rows = spark.read.parquet(f"{root}/{name}")
    rows = rows if number is None else rows.filter(F.col("batch") <= number)
    rest = [c for c in rows.columns if c not in ("entity_id", "batch")]
    g = rows.groupBy("entity_id").agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return g.select("entity_id", *[F.col(f"row.{c}") for c in rest])
