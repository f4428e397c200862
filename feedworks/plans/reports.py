"""Data-quality reports over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedworks import contracts
from feedworks.operators.quality import duplicate_keys, error_summary
from feedworks.plans.layout import Layout


def quality_reports(spark: SparkSession, layout: Layout) -> dict[str, DataFrame]:
    return {
        "member_errors": error_summary(layout.member_quarantine.read(spark)),
        "redemption_errors": error_summary(
            layout.redemption_quarantine.read(spark)
        ),
        "duplicate_members": duplicate_keys(
            layout.member_target.read(spark), contracts.MEMBER_KEY
        ),
        "duplicate_transactions": duplicate_keys(
            layout.redemption_target.read(spark), contracts.TRANSACTION_KEY
        ),
    }
