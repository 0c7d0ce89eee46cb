"""Trial logs and result logs: typed, appended as Parquet, exported as text."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

RESULT_SCHEMA = StructType([
    StructField("dataset_id", LongType()),
    StructField("dataset_name", StringType()),
    StructField("model", StringType()),
    StructField("run_kind", StringType()),
    StructField("outer_run", IntegerType()),
    StructField("params", MapType(StringType(), StringType())),
    StructField("mse", DoubleType()),
    StructField("mae", DoubleType()),
    StructField("max_absolute_error", DoubleType()),
    StructField("nll_score", DoubleType()),
    StructField("train_time", DoubleType()),
])

TRIAL_SCHEMA = StructType([
    StructField("dataset_id", LongType()),
    StructField("dataset_name", StringType()),
    StructField("model", StringType()),
    StructField("outer_cv_split", IntegerType()),
    StructField("number", LongType()),
    StructField("value", DoubleType()),
    StructField("datetime_start", TimestampType()),
    StructField("datetime_complete", TimestampType()),
    StructField("params", MapType(StringType(), StringType())),
    StructField("metric", StringType()),
    StructField("max_epochs", IntegerType()),
    StructField("train_losses", ArrayType(DoubleType())),
    StructField("state", StringType()),
    StructField("message", StringType()),
])


def read_log(spark: SparkSession, path: str, schema: StructType = RESULT_SCHEMA) -> DataFrame:
    """The log at ``path``, or an empty table with the same columns."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def concat_logs(logs: Iterable[DataFrame]) -> DataFrame:
    """Union by column name; a column one log lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def append_log(df: DataFrame, path: str, partition_by: Sequence[str] = ("dataset_name", "model")) -> None:
    """Add rows to a log without rewriting it."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Text with header and without index, replacing what was there."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
