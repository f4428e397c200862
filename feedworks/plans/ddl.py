"""Catalog tables over the stored layers, for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from feedworks.plans.layout import Layout
from feedworks.sinks.layers import BATCH
from feedworks.sources.storage import exists, quoted


def _stored(layout: Layout) -> dict[str, tuple[str, str, str, str]]:
    """Columns, format, partition column and path by table name."""
    layers = {
        "member_file_control": layout.member_ledger,
        "member_profile_raw": layout.member_raw,
        "member_profile_staging": layout.member_staging,
        "member_profile_quarantine": layout.member_quarantine,
        "redemption_file_control": layout.redemption_ledger,
        "redemption_transactions_quarantine": layout.redemption_quarantine,
    }
    targets = {
        "member_profile_target": layout.member_target,
        "redemption_transactions": layout.redemption_target,
    }
    stored = {
        name: (f"{layer.columns}, {BATCH} STRING", layer.fmt, BATCH, layer.path)
        for name, layer in layers.items()
    }
    for name, target in targets.items():
        stored[name] = (
            target.columns, target.fmt, target.partition_by, target.data_path
        )
    return stored


def table_statements(layout: Layout) -> dict[str, str]:
    """``CREATE TABLE`` text by table name. Layers are partitioned by batch."""
    return {
        name: (
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt} "
            f"PARTITIONED BY ({partition}) LOCATION {quoted(path)}"
        )
        for name, (columns, fmt, partition, path) in _stored(layout).items()
    }


def create_tables(spark: SparkSession, layout: Layout) -> None:
    """Create what is missing and match the partitions to what is stored."""
    stored = _stored(layout)
    for name, statement in table_statements(layout).items():
        spark.sql(statement)
        if exists(spark, stored[name][-1]):
            spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
            spark.sql(f"REFRESH TABLE {name}")
