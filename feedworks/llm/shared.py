"""What the operators share: tables, stored steps, ids of rows, tasks over Arrow."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.sources.storage import delete, scratch_path

# The words of every contract are runs without these characters.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"

# Limits of value_at_rank: bins of a round, rows that may come to the driver.
BINS = 4096
FINE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Paths that ``stored`` has written in this process, for ``drop_steps``.
STEPS: list[str] = []


def drop_steps(spark: SparkSession, paths: list[str], needed_by: DataFrame) -> None:
    """Delete stored steps that ``needed_by`` does not read."""
    read = needed_by.inputFiles()
    for path in paths:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in name for name in read):
            delete(spark, path)


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage: a lost executor costs a reread, not a recomputation. The
    folder goes when the driver ends, or earlier by ``delete``.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    STEPS.append(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete(spark, path)


def remainder(column: Column, divisor: int) -> Column:
    """crc32 of a value's text, modulo ``divisor``; NULL counts as empty text."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % divisor


def whole_text(column: str = "text") -> Column:
    """The text, NULL as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(
        column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``used`` under names no operator uses, and
    the names to give ``restored``."""
    names = {c: c if c in used else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns ``set_aside`` was given, in their order, and no others."""
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches to ``size`` rows, so a task's memory does not follow them."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, NULL as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def value_at_rank(values: DataFrame, k: int) -> float:
    """The k-th largest of the numbers ``v``: counts in ever finer bins
    until few rows are left, so neither a sort nor a long list is needed."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while True:
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        width = (high - low) / BINS
        if inside.limit(FINE + 1).count() <= FINE or not low + width > low:
            rows = inside.groupBy("v").count().orderBy(F.desc("v")).limit(FINE + 1).collect()
            for row in rows:
                k -= row["count"]
                if k <= 0:
                    return row.v
            return low
        bin_of = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(bin_of.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r.bin):
            if k <= row.n:
                low, high = row.low, row.high
                break
            k -= row.n
