"""Table scans by path or name, in whatever file format the caller uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet"
) -> DataFrame:
    """A table whose columns are known: nothing is inferred, no footer is
    merged, and files that lack a later-added column give NULL for it."""
    return spark.read.format(fmt).schema(schema).load(path)


def sql_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The same through SQL, where the path stands in for a table name."""
    return spark.sql(f"SELECT * FROM {fmt}.`{path}`")
