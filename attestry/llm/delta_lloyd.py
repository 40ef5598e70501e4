"""Delta Lloyd: centroid clustering on integers, each round doing only what changed.

The table of vectors with their owner and distance is written each round; global sums and counts of the clusters live on the driver (``k`` rows,
whatever the input). A round compares a vector whose owner stayed as it was with the centroids that changed only, and one whose owner
moved with all of them. Vectors that went over from one cluster to another give a signed transfer (minus to the old, plus to the new),
summed by Spark; sums and centroids follow from the transfers alone.

Components become floor(256 x) and all that follows is exact: distances, sums, floor(sum / count).

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; fewer vectors than ``k``
give as many centroids; a null id takes part, after the others as a first centroid; equal vectors and repeated ids are rows of their
own; an empty table gives no rows; other columns are not looked at. A component beyond 2^27 in size stops the run with an error, as its distance is no long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import release, stage

#: Squared distances stay below 2^53 up to this size of components, so that floats are exact.
EXACT = 1 << 22


def kept_vectors(vectors: DataFrame, dim: int, scale: int, vector: str, key: str) -> DataFrame:
    """(key, x): x as integers. The ids keep their type."""
    v = F.col("v")
    usable = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(usable)
    far = F.exists("x", lambda x: F.abs(x) > (1 << 27))
    rows = rows.select("key", F.transform(v, lambda x: F.floor(F.lit(scale) * x)).alias("x"))
    return rows.withColumn("x", F.when(far, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("x")))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    small = max(abs(x).max(initial=0), abs(centroids).max(initial=0)) < EXACT // x.shape[1]
    a, b = (x.astype(np.float64), centroids.astype(np.float64)) if small else (x, centroids)
    if small:
        out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return out.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, changed: np.ndarray, block: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows (key, x, cluster, distance) with their new owner, and the one before in ``was``."""
    moved = np.flatnonzero(changed)
    for whole in batches:
        for at in range(0, whole.num_rows, block):
            batch = whole.slice(at, block)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            cluster, distance = was.copy(), batch.column("distance").to_numpy(zero_copy_only=False).copy()
            anew = changed[was] | (was < 0)
            if anew.any():
                far = distances(x[anew], centroids)
                cluster[anew] = far.argmin(1)
                distance[anew] = far.min(1)
            stay = np.flatnonzero(~anew)
            if len(stay) and len(moved):
                far = distances(x[stay], centroids[moved])
                best, near = moved[far.argmin(1)], far.min(1)
                better = (near < distance[stay]) | ((near == distance[stay]) & (best < was[stay]))
                cluster[stay[better]], distance[stay[better]] = best[better], near[better]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32())], ["key", "x", "cluster", "distance", "was"])


def transfers(rows: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, s0, s1, ...): what each cluster gains and loses by the vectors whose owner changed."""
    moves = F.array(F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign")), F.struct("cluster", F.lit(1).alias("sign")))
    rows = rows.filter("cluster <> was").select("x", F.explode(moves).alias("m")).filter("m.cluster >= 0")
    return rows.groupBy("m.cluster").agg(F.sum("m.sign").alias("n"), *[F.sum(F.col("m.sign") * F.col("x")[i]).alias(f"s{i}") for i in range(dim)])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2", vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, np.ndarray, list[dict]]:
    """((key, x, cluster, distance) of every kept vector, final centroids, per round the changed centroids and the vectors that changed owner).
    First centroids are the vectors with the smallest sha256 of ``seed:key``."""
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, dim, scale, vector, key)
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "x").limit(k)
    centroids = np.array([r.x for r in first.select("x").collect()], np.int64).reshape(-1, dim)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, x array<bigint>, cluster int, distance bigint, was int"
    now = rows.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("bigint")})
    # Python's integers: the sums of a large table leave 64 bits
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    changed, before, did = np.ones(len(centroids), bool), None, []
    if not len(centroids):
        return now.limit(0).select("key", "x", "cluster", "distance"), centroids, did
    for i in range(rounds + 1):
        if before is None or changed.any():
            now = stage(now.select("key", "x", "cluster", "distance").mapInArrow(lambda b, c=centroids, m=changed: _assigned(b, c, m), schema), "vectors")
            if before is not None:
                release(spark, before)
            before = now
            gains = transfers(now, dim).collect() if i < rounds else []  # two rows a centroid at most
            did.append({"changed": int(changed.sum()), "moves": sum(max(0, g.n) for g in gains)})
        else:
            break  # nothing moved: all further rounds give the same
        new = centroids.copy()
        for g in gains:
            counts[g.cluster] += g.n
            sums[g.cluster] = [s + g[f"s{j}"] for j, s in enumerate(sums[g.cluster])]
            if counts[g.cluster]:
                new[g.cluster] = [s // counts[g.cluster] for s in sums[g.cluster]]
        if i < rounds:
            changed, centroids = (new != centroids).any(1), new
    return now.select("key", "x", "cluster", "distance"), centroids, did


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds each cluster's and the whole inertia, and the digest of the centroid. One row a cluster comes to the driver."""
    spark = rows.sparkSession
    per = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    told = [(c, int(n), int(sum(per.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in per.items()]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster")
