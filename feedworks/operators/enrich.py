"""Attach dimension attributes to facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich_with_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    fact_key: str,
    dimension_key: str,
    fact_columns: Sequence[str],
    attributes: Sequence[str],
) -> DataFrame:
    """Left join; facts without a match keep NULL attributes.

    No hint: Spark broadcasts the dimension only when its size allows, and
    otherwise sort-merges, where adaptive execution splits the partition of a
    fact key that is far more frequent than the rest.
    """
    return (
        facts.alias("fact")
        .join(
            dimension.alias("dim"),
            F.col(f"fact.{fact_key}") == F.col(f"dim.{dimension_key}"),
            "left_outer",
        )
        .select(
            *[F.col(f"fact.{c}") for c in fact_columns],
            *[F.col(f"dim.{c}") for c in attributes],
        )
    )
