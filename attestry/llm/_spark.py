"""Small helpers shared by the training-data operators: shared-folder tables, name clashes, hashing of row identity."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only where it is unset (single-machine tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.gettempdir().rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


#: Bytes of a batch that goes to a Python worker: a batch is held on both sides, by each task of an executor.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, never recomputed. Batches for Python
    workers are kept small while it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{name}-{uuid.uuid4().hex}"
    key, most = _BATCH
    before = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > most:
        spark.conf.set(key, str(most))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stage tables that no later step reads and let Spark drop the shuffle files of finished stages."""
    jvm = spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._attestry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # finished plans that Python still holds would keep their shuffle files
    jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of ``docs`` can never clash with an operator's own names."""
    return docs.select(*[F.col(f"`{n}`") for n in names])
