"""Sharding by size-tiered compaction with an atomically committed, versioned manifest.

Arrivals are appended as small immutable Parquet shards, just as Spark's tasks hold them: no shuffle. Live shards lie in tiers by size
(each tier ``fanout`` times the one before). Compaction merges the shards of a tier once it has ``fanout`` of them, into files of the
target size at most, by a scan that packs whole small files into one task each, so that merging moves no rows between tasks either;
what it makes lies in a higher tier and may complete that one. Tiers with fewer shards wait, shards of more than half the target are left alone.

A manifest version is one file, ``v<number>.json``: the shards that the version adds and drops, and every ``snapshot``-th version all that
are live. It is written whole under another name and then moved to its own, which fails if another writer made that version first (a hard
link on local disks, a rename that doesn't overwrite elsewhere; a store without such a rename needs another commit). Readers see a version whole or not at
all, and files of a lost executor or failed writer are in no version. Files are only ever added; :meth:`ShardStore.vacuum` deletes what no
kept version names.

The driver holds one manifest entry a file, some 200 bytes for up to ``target_bytes`` of data.

Defined cases: rows are kept as they are, nulls, repeated rows and texts of any length; an empty arrival commits a shard
without rows; equal file sizes merge in path order; columns are those of the first arrival; columns named like those of :meth:`ShardStore.places` keep their
names, and the store's get an underscore in front.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int
    version: int

    @property
    def name(self) -> str:
        """Version and number of the file: the same in every run that deals rows alike."""
        part = re.match(r"part-(\d+)", self.path.rsplit("/", 1)[1])
        return f"v{self.version}-{self.path.rsplit('/', 2)[1].split('-')[1]}-{part[1] if part else 0}"


class ShardStore:
    """A sharded table under ``root``, a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, small_bytes: int = 4 << 20, fanout: int = 4, snapshot: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small, self.fanout, self.snapshot = target_bytes, small_bytes, fanout, snapshot
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifest

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [re.fullmatch(r"v(\d+)\.json", s.getPath().getName()) for s in self._fs.listStatus(folder)]
        return max([int(n[1]) for n in names if n], default=0)

    def _manifest(self, version: int) -> dict:
        path = self._path(f"{self.root}/manifest/v{version}.json")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        """Live shards of a version, by path."""
        version = self.version() if version is None else version
        changes = []
        while version > 0:
            changes.append(self._manifest(version))
            if changes[-1]["whole"]:
                break
            version -= 1
        live: dict[str, Shard] = {}
        for change in reversed(changes):
            for path in change["dropped"]:
                live.pop(path, None)
            live |= {s["path"]: Shard(**s) for s in change["added"]}
        return [live[p] for p in sorted(live)]

    def _commit(self, added: list[Shard], dropped: list[Shard], version: int) -> None:
        gone = {s.path for s in dropped}
        whole = version == 1 or version % self.snapshot == 0
        if whole:
            added, gone = [s for s in self.shards(version - 1) if s.path not in gone] + added, set()
        content = {"version": version, "whole": whole, "added": [asdict(s) for s in added], "dropped": sorted(gone)}
        temporary, final = (self._path(f"{self.root}/manifest/{n}") for n in (f"_tmp-{uuid.uuid4().hex}", f"v{version}.json"))
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            if not self._moved(temporary, final):
                raise RuntimeError(f"version {version} was committed by another writer")
        finally:
            self._fs.delete(temporary, False)

    def _moved(self, temporary, final) -> bool:
        """One atomic step that fails where ``final`` is there already."""
        if self._fs.getScheme() == "file":
            try:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return self._fs.rename(temporary, final)

    # data

    def tier(self, size: int) -> int:
        """0 up to ``small_bytes``, one more for each further factor of ``fanout``."""
        tier, limit = 0, self.small
        while size > limit:
            tier, limit = tier + 1, limit * self.fanout
        return tier

    def _written(self, folder: str, version: int) -> list[Shard]:
        status = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        sizes = {s.getPath().getName(): s.getLen() for s in status}
        counts = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()
        rows = {r["name"]: r["n"] for r in counts}
        return [Shard(f"{folder}/{n}", rows.get(n, 0), size, self.tier(size), version) for n, size in sizes.items()]

    def append(self, docs: DataFrame) -> int:
        """Commit ``docs`` as new small shards; the new version."""
        old = self.version()
        folder = f"{self.root}/data/v{old + 1}-a-{uuid.uuid4().hex}"
        docs.write.option("compression", "zstd").parquet(folder)
        self._commit(self._written(folder, old + 1), [], old + 1)
        return old + 1

    def compact(self) -> int:
        """Merge each tier that has ``fanout`` shards or more, from the smallest up, with what the merges below made, and commit the result;
        the version, unchanged if no tier was due."""
        old = self.version()
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards(old):
            if 2 * s.bytes <= self.target:
                tiers.setdefault(s.tier, []).append(s)
        made: list[Shard] = []
        dropped: list[Shard] = []
        tier = min(tiers, default=0)
        while tiers and tier <= max(tiers):
            group = tiers.pop(tier, [])
            if len(group) >= self.fanout:
                new = self._merge(group, old + 1, tier)
                dropped += group
                made += new
                for s in new:
                    if s.tier > tier and 2 * s.bytes <= self.target:
                        tiers.setdefault(s.tier, []).append(s)
            tier += 1
        if not dropped:
            return old
        # what was made and merged again within this compaction was never live
        gone = {s.path for s in dropped}
        brief = {s.path for s in made} & gone
        self._commit([s for s in made if s.path not in brief], [s for s in dropped if s.path not in brief], old + 1)
        return old + 1

    def _merge(self, group: list[Shard], version: int, tier: int) -> list[Shard]:
        """One Spark job for a tier: a scan of its files, packed whole into partitions up to the target size, written file by file."""
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        folder = f"{self.root}/data/v{version}-t{tier}-{uuid.uuid4().hex}"
        session.read.parquet(*[s.path for s in group]).write.option("compression", "zstd").parquet(folder)
        return self._written(folder, version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        shards = self.shards(version)
        if not shards:
            raise ValueError("no shard was committed")
        return self.spark.read.parquet(*[s.path for s in shards])

    def places(self, *columns: str, version: int | None = None) -> DataFrame:
        """``columns`` of the rows of a version with the shard (its name), row (place in it), shard_rows, shard_bytes, tier and version they are in."""
        shards = self.shards(version)
        own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_own")
        rows = self.read(version).select(own, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("row"))
        table = [(s.path.rsplit("/", 1)[1], s.name, s.rows, s.bytes, s.tier, s.version) for s in shards]
        placed = rows.join(self.spark.createDataFrame(table, "_file string, shard string, shard_rows bigint, shard_bytes bigint, tier int, version int"), "_file")
        names = {c: f"_{c}" if c in columns else c for c in ("shard", "row", "shard_rows", "shard_bytes", "tier", "version")}
        return placed.select(*[F.col(f"_own.`{c}`").alias(c) for c in columns], *[F.col(c).alias(n) for c, n in names.items()])

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data folders that no version of the last ``keep_versions`` names, and manifests that none is built on; the number of folders
        deleted. Not to be run beside a writer, whose files are in no version yet."""
        now = self.version()
        kept = range(max(1, now - keep_versions + 1), now + 1)
        named = {s.path.rsplit("/", 2)[1] for v in kept for s in self.shards(v)}
        gone = 0
        for status in self._fs.listStatus(self._path(f"{self.root}/data")):
            if status.getPath().getName() not in named:
                gone += bool(self._fs.delete(status.getPath(), True))
        base = kept[0]
        while base > 1 and not self._manifest(base)["whole"]:
            base -= 1
        for v in range(base - 1, 0, -1):
            if not self._fs.delete(self._path(f"{self.root}/manifest/v{v}.json"), False):
                break
        return gone


def shard(docs: DataFrame, root: str, arrivals: int = 1, **sizes: int) -> ShardStore:
    """A store of ``docs`` under ``root``, arrived in ``arrivals`` parts (by a hash of the row), compacted and vacuumed."""
    store = ShardStore(docs.sparkSession, root, **sizes)
    for i in range(arrivals):
        store.append(docs if arrivals == 1 else docs.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(arrivals)) == i))
    store.compact()
    store.vacuum()
    return store
