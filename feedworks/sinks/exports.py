"""Per-segment tables and formatted file exports."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.sinks.switch import Switch
from feedworks.sources.storage import quoted

SEGMENT = "segment"


@dataclass(frozen=True)
class ExportColumn:
    """``source`` under the header ``title``; dates take ``fmt``.

    ``source=None`` is a column the receiver expects and nobody fills.
    """

    source: str | None
    title: str
    fmt: str | None = None

    def column(self) -> Column:
        if self.source is None:
            value = F.lit(None).cast("string")
        elif self.fmt:
            value = F.date_format(self.source, self.fmt)
        else:
            value = F.col(self.source)
        return value.alias(self.title)


@dataclass(frozen=True)
class Segment:
    """Rows where the segment column equals ``value``; a table, maybe a file."""

    value: str
    name: str
    table: str
    export: tuple[ExportColumn, ...] | None = None


def segment_path(root: str, segment: Segment) -> str:
    return f"{root}/{SEGMENT}={segment.name}"


def fan_out(
    df: DataFrame,
    root: str,
    column: str,
    segments: Sequence[Segment],
    columns: Sequence[str],
    only: Collection | None = None,
) -> None:
    """Write segment tables in one job, replacing what was there.

    With ``only``, segments of other values keep their files. The new files are
    written beside the tables and then switched in, so a write that fails leaves
    every table as it was, and one that dies after the switch is finished by the
    next call. The segment column picks the folder and stays in the files, so each
    folder is a complete table of its own. No shuffle: each task writes its share
    of every segment. Segments left without rows read as empty.
    """
    spark = df.sparkSession
    switch = Switch(root, f"{root}/_pending")
    finish_fan_out(spark, root)
    chosen = [s for s in segments if only is None or s.value in only]
    if not chosen:
        return
    name = F.lit(None).cast("string")
    for segment in chosen:
        name = F.when(F.col(column) == segment.value, segment.name).otherwise(name)
    (
        df.filter(F.col(column).isin([segment.value for segment in chosen]))
        .select(*columns, name.alias(SEGMENT))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(SEGMENT)
        .parquet(switch.rows)
    )
    old = [
        file
        for segment in chosen
        for file in switch.held_below(spark, f"{SEGMENT}={segment.name}")
    ]
    switch.commit(spark, old)
    finish_fan_out(spark, root)


def finish_fan_out(spark: SparkSession, root: str) -> None:
    """Put completely written files in place; safe to repeat."""
    switch = Switch(root, f"{root}/_pending")
    if switch.ready(spark):
        switch.move(spark)
        switch.remove(spark, switch.removed(spark))
        switch.end(spark)


def register_segments(
    spark: SparkSession, root: str, segments: Sequence[Segment], columns: str
) -> None:
    """External catalog tables over the segment folders; tables that are there
    already, for another root, are pointed to this one."""
    for segment in segments:
        place = quoted(segment_path(root, segment))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {segment.table} ({columns}) "
            f"USING parquet LOCATION {place}"
        )
        spark.sql(f"ALTER TABLE {segment.table} SET LOCATION {place}")
        spark.catalog.refreshTable(segment.table)


def export_view(df: DataFrame, segment: Segment) -> DataFrame:
    return df.select(*[column.column() for column in segment.export])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes; NULL and empty print as nothing.

    Every task writes its own part file, so no task holds the whole export.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_segments(
    df: DataFrame, root: str, column: str, segments: Sequence[Segment]
) -> list[str]:
    """Write the file of each segment that has one; return the skipped names."""
    skipped = []
    for segment in segments:
        if segment.export is None:
            skipped.append(segment.name)
            continue
        rows = df.filter(F.col(column) == segment.value)
        write_csv(export_view(rows, segment), f"{root}/{segment.table}.csv")
    return skipped
