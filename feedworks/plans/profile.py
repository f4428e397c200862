"""Transactions with the profile of the member who made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedworks import contracts
from feedworks.operators.enrich import enrich_with_dimension

VIEW = "member_redemption_profile"
# The columns people ask for by hand.
BRIEF_ATTRIBUTES = ("name", "country_code", "tier", "stale_member")


def member_redemption_profile(
    transactions: DataFrame,
    members: DataFrame,
    attributes=contracts.MEMBER_ATTRIBUTES,
) -> DataFrame:
    return enrich_with_dimension(
        transactions,
        members,
        "member_id",
        "mem_id",
        contracts.TRANSACTION_FACTS,
        attributes,
    )


def create_profile_view(
    spark: SparkSession,
    transactions: str = "redemption_transactions",
    members: str = "member_profile_target",
) -> None:
    """The same as a catalog view over two catalog tables."""
    facts = ", ".join(f"t.{c}" for c in contracts.TRANSACTION_FACTS)
    attributes = ", ".join(f"m.{c}" for c in contracts.MEMBER_ATTRIBUTES)
    spark.sql(
        f"CREATE OR REPLACE VIEW {VIEW} AS SELECT {facts}, {attributes} "
        f"FROM {transactions} t LEFT JOIN {members} m ON t.member_id = m.mem_id"
    )
