"""A log whose rows belong to runs, and which a rerun replaces instead of doubling.

Rows of an attempt are written first, in a folder of their own; then one small
file says that this attempt is now what the run consists of. Rows without such a
commit are never read, so an attempt that fails between its files leaves no trace, and
writing a run again puts the new rows in the place of the old. ``compact`` writes
the current rows of all runs into one attempt and commits all of them at once.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nestfold.sources.results import RESULT_SCHEMA
from nestfold.sources.storage import remove

COMMITS = "run_key string, attempt string, version long"
_RUN = "_run_key"


class RunLog:
    """The log at ``path`` for rows of ``schema``; missing columns of a write are null."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType = RESULT_SCHEMA):
        if _RUN in schema.names:
            raise ValueError(f"the column name {_RUN} is taken")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.stored = StructType([*schema.fields, StructField(_RUN, StringType())])

    def commits(self) -> DataFrame:
        """(run_key, attempt): which attempt each run consists of."""
        try:
            every = self.spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
            every = self.spark.createDataFrame([], COMMITS)
        return every.groupBy("run_key").agg(F.max_by("attempt", F.struct("version", "attempt")).alias("attempt"))

    def has(self, run_key: str) -> bool:
        return not self.commits().filter(F.col("run_key") == run_key).isEmpty()

    def _rows(self) -> DataFrame:
        current = self.commits()
        attempts = [r.attempt for r in current.select("attempt").distinct().collect()]  # one for each run at most
        if not attempts:
            return self.spark.createDataFrame([], self.stored)
        files = self.spark.read.schema(self.stored).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/rows/{a}" for a in attempts])
        held = files.withColumn("_attempt", F.regexp_extract(F.col("_metadata.file_path"), r"/rows/([0-9a-f]+)/", 1))
        return held.join(F.broadcast(current.select(F.col("run_key").alias(_RUN), F.col("attempt").alias("_attempt"))), [_RUN, "_attempt"], "left_semi").drop("_attempt")

    def read(self, run_key: str | None = None) -> DataFrame:
        """The rows of all runs, or of one."""
        rows = self._rows()
        return (rows if run_key is None else rows.filter(F.col(_RUN) == run_key)).select(*self.schema.names)

    def _write_rows(self, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{attempt}")
        return attempt

    def _commit(self, keys: list[str], attempt: str) -> None:
        entries = self.spark.createDataFrame([(k, attempt, time.time_ns()) for k in keys], COMMITS)
        entries.coalesce(1).write.parquet(f"{self.path}/commits/{uuid.uuid4().hex}")  # writers do not share a folder

    def write(self, run_key: str, rows: DataFrame) -> None:
        """Make ``rows`` what the run consists of."""
        filled = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                  for f in self.schema.fields]
        self._commit([run_key], self._write_rows(rows.select(*filled, F.lit(run_key).alias(_RUN))))

    def compact(self) -> None:
        """Put all runs into one attempt, and remove the files that no run consists of any more.

        Not for a log that another driver is writing to: its rows are not committed yet.
        """
        current = self.commits().collect()
        if not current:
            return
        attempt = self._write_rows(self._rows().coalesce(1))
        self._commit([r.run_key for r in current], attempt)
        for old in {r.attempt for r in current}:
            remove(self.spark, f"{self.path}/rows/{old}")
