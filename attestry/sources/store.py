"""A store of claims in buckets of entities, with one atomic version over claims, changesets and the record of the run.

An entity's claims are in the bucket of its hash. What a source says touches some buckets; only these are read and written again, the others stay
where they are. A version is one small file that names the folder of each bucket; until it is there, readers see the version before, so a run
that dies half way leaves nothing but folders that no version names (:meth:`ClaimStore.vacuum`). Of two writers one commits, the other tries
again on what the first has made.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import claims as C
from ..operators._shared import scratch, stored
from .commits import Versions

CLAIMS = (
    "claim_id bigint, entity_type string, entity_id bigint, source_id bigint, field_name string, claim_key string, value string, citation string, needs_review boolean, "
    "needs_review_notes string, license_id bigint, is_active boolean"
)
CHANGESETS = "changeset_id bigint, version bigint, entity_type string, entity_id bigint, made bigint, closed bigint"


class Conflict(RuntimeError):
    """Another writer committed again and again."""


class ClaimStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, files: int = 4):
        """``buckets`` holds for a new store; a store that is there keeps its own. ``files``: a bucket's claims are dealt over as many tasks and files,
        by claim key, as one entity may have many claims."""
        self.spark, self.root, self.files = spark, root.rstrip("/"), files
        self.versions = Versions(spark, f"{self.root}/versions")
        self.buckets = self.manifest()["buckets"] if self.version() else buckets

    def version(self) -> int:
        return self.versions.latest()

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"buckets": getattr(self, "buckets", 0), "last_claim": 0, "last_changeset": 0, "claims": {}, "changesets": {}, "run": None}
        return self.versions.read(version)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("entity_type", "entity_id"), F.lit(self.buckets)).cast("int")

    def read(self, table: str = "claims", version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """``claims`` or ``changesets`` of a version, or of some of its buckets."""
        schema = T.StructType.fromDDL(CLAIMS if table == "claims" else CHANGESETS)
        places = self.manifest(version)[table]
        folders = [f"{self.root}/data/{places[b]}" for b in sorted(places) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def runs(self) -> list[dict]:
        return [self.manifest(v)["run"] for v in range(1, self.version() + 1)]

    def _write(self, rows: DataFrame, name: str, spread: str) -> None:
        dealt = rows.withColumn("bucket", self.bucket()).repartition(F.col("bucket"), F.pmod(F.xxhash64(spread), F.lit(self.files)))
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")

    def _folders(self, name: str) -> dict[str, str]:
        found = self.versions.fs.listStatus(self.versions.path(f"{self.root}/data/{name}"))
        names = [s.getPath().getName() for s in found]
        return {n.split("=")[1]: f"{name}/{n}" for n in names if n.startswith("bucket=")}

    def apply(self, pending: DataFrame, source_id: int, sweep: list[str] | None = None, scope: DataFrame | None = None, name: str = "apply", tries: int = 5) -> dict:
        """Commit what ``source_id`` says (columns of claims but claim_id, source_id, is_active, and seq); the record of the run."""
        with scratch():
            pending = stored(pending, "pending")
            for _ in range(tries):
                if run := self._applied(pending, source_id, sweep, scope, name):
                    return run
        raise Conflict(f"{tries} versions were committed by others meanwhile")

    def _applied(self, pending: DataFrame, source_id: int, sweep: list[str] | None, scope: DataFrame | None, name: str) -> dict | None:
        old = self.version()
        before, began = self.manifest(old), datetime.now(timezone.utc)
        said = pending.select(self.bucket().alias("b"))
        if scope is not None:
            said = said.unionByName(scope.select(self.bucket().alias("b")))
        touched = sorted(r.b for r in said.distinct().collect())  # no more than there are buckets
        folder = f"v{old + 1}-{uuid.uuid4().hex}"
        claims = self.read("claims", old, touched)
        after, counts = C.applied(claims, pending, source_id, sweep, scope, before["last_claim"])
        self._write(after, f"{folder}/claims", "claim_key")
        now = self.spark.read.schema(CLAIMS).parquet(f"{self.root}/data/{folder}/claims")
        done = {r.action: r.n for r in counts.collect()}

        was = claims.filter("is_active").select("claim_id", F.lit(True).alias("_was"))
        closed = now.filter("NOT is_active").join(was, "claim_id", "left_semi").select("entity_type", "entity_id", F.lit(0).alias("made"), F.lit(1).alias("closed"))
        made = now.filter(F.col("claim_id") > before["last_claim"]).select("entity_type", "entity_id", F.lit(1).alias("made"), F.lit(0).alias("closed"))
        per = made.unionByName(closed).groupBy("entity_type", "entity_id").agg(F.sum("made").alias("made"), F.sum("closed").alias("closed"))
        fresh = C.numbered(per, ["entity_type", "entity_id"]).select(
            (F.col("number") + before["last_changeset"]).alias("changeset_id"), F.lit(old + 1).cast("bigint").alias("version"), "entity_type", "entity_id", "made", "closed"
        )
        fresh = stored(fresh, "changesets")
        # changesets of a bucket are written again with its claims
        self._write(self.read("changesets", old, touched).unionByName(fresh), f"{folder}/changesets", "changeset_id")
        run = {
            "name": name, "version": old + 1, "source_id": source_id, "began": began.isoformat(), "ended": datetime.now(timezone.utc).isoformat(), "counts": done, "changesets": fresh.count(), "buckets": len(touched),
        }
        content = before | {
            "buckets": self.buckets, "last_claim": before["last_claim"] + done.get("create", 0) + done.get("supersede", 0), "last_changeset": before["last_changeset"] + run["changesets"],
            "claims": before["claims"] | self._folders(f"{folder}/claims"), "changesets": before["changesets"] | self._folders(f"{folder}/changesets"), "run": run,
        }
        return run if self.versions.commit(old + 1, content) else None

    def vacuum(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions names; how many. Not to be run beside a writer."""
        now, fs = self.version(), self.versions.fs
        named = {f.split("/")[0] for v in range(max(1, now - keep + 1), now + 1) for t in ("claims", "changesets") for f in self.manifest(v)[t].values()}
        gone = [s.getPath() for s in fs.listStatus(self.versions.path(f"{self.root}/data")) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
