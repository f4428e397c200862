"""Keep one winning row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """First row of each key under ``order``; NULL is a key like any other.

    ``row_number() = 1`` lets Spark cut every map task down to one row per key
    before the shuffle, so a key that holds a large share of the table sends
    one row per task to its reducer, not its whole history.
    """
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, ranked).filter(F.col(_RANK) == 1).drop(_RANK)


def newest_first(columns: Sequence[Column]) -> list[Column]:
    return [column.desc_nulls_last() for column in columns]


def settle_ties(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """Order by every remaining column, so equal ranks have one fixed winner."""
    return newest_first([F.col(c) for c in df.columns if c not in used])
