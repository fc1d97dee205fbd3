"""JSON lines and checkpoints."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line; blank lines are skipped and a bad line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of parts, non-ASCII text as it is, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of finished batches, none if the checkpoint isn't there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_checkpoint(df: DataFrame, path: str, by: tuple[str, ...] = ("batch_id",)) -> None:
    """Rows of further batches beside the earlier ones. What is written of a value of `by` replaces what was there of it, so that a batch that is tried again is there once; take a column of few values, such as the run."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
