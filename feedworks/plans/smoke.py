"""A first check of a deployment: can it write and read back partitions?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedworks.sinks.targets import write_partitioned
from feedworks.sources.tables import read_table

COLUMNS = "member_id STRING, member_name STRING, country_code STRING"
ROWS = [("1", "Ada", "USA"), ("2", "Bela", "IND"), ("3", "Caro", "PHL")]


def storage_check(spark: SparkSession, path: str) -> DataFrame:
    """Rows as read back, in order; fails if any is missing."""
    sent = spark.createDataFrame(ROWS, COLUMNS)
    write_partitioned(sent, path, "country_code")
    found = read_table(spark, path, COLUMNS)
    count = found.count()
    if count != len(ROWS):
        raise RuntimeError(f"wrote {len(ROWS)} rows to {path}, read {count}")
    return found.orderBy("member_id")
