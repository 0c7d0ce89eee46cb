"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from typing import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a fresh temporary folder; on
    a cluster the setting is required, since a local path would be lost with
    its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="nestfold-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_SCOPES: list[list[str]] = []
_SCOPES_LOCK = threading.Lock()
_SMALL_BATCHES = threading.RLock()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _SCOPES_LOCK:
        if _SCOPES:
            _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own, wherever Spark's file systems keep it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, all intermediate tables that were made inside.

    What is wanted later has to be written or collected before the scope ends.
    Threads started inside belong to it; scopes nest.
    """
    with _SCOPES_LOCK:
        _SCOPES.append([])
        mine = _SCOPES[-1]
    try:
        yield
    finally:
        with _SCOPES_LOCK:
            _SCOPES.remove(mine)
        for path in mine:
            remove(spark, path)


def materialize(df: DataFrame, name: str = "step", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    Later passes read Parquet with pruned columns instead of repeating the plan,
    and a lost executor costs a re-read, not a recomputation of the whole chain.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_up_to(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside get Arrow batches of about ``size`` bytes at most.

    Wide rows otherwise fill batches of 64 MB, which each running task holds several times,
    in the executor and in its Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with _SMALL_BATCHES:
        before = spark.conf.get(name)
        spark.conf.set(name, str(size))
        try:
            yield
        finally:
            spark.conf.set(name, before)
