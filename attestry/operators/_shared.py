"""Tables of intermediate results in the folder that every executor sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs on one machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.gettempdir().rstrip("/") + "/checkpoints"
    return conf.rstrip("/")


#: rows of a table that a task of a join or an aggregate takes, so that its memory doesn't grow with the table
ROWS_A_TASK = 500_000


def parts_for(rows: DataFrame, each: int = 1) -> int:
    """How many partitions ``rows`` should be dealt over if each gives ``each`` rows: at least as many as a shuffle has. Counts the rows: for tables as they are read."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * each // ROWS_A_TASK))


_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: what it holds is the same for every reader, and no longer plan hangs on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are stored inside are deleted at the end: for steps that have written what they give."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        dropped(*made)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._attestry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
