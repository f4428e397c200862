"""Column helpers for text fields and the predicates rules are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedworks import contracts


def clean(column: Column) -> Column:
    """Trim spaces; an empty field becomes NULL."""
    return F.nullif(F.trim(column), F.lit(""))


def normal_code(column: Column) -> Column:
    return F.upper(F.trim(column))


def is_blank(column: Column) -> Column:
    """True for NULL, empty and all-space values; never NULL."""
    return F.coalesce(F.trim(column), F.lit("")) == ""


def longer_than(column: Column, limit: int) -> Column:
    return F.length(F.trim(column)) > limit


def outside(column: Column, allowed) -> Column:
    """Not one of ``allowed``; NULL stays NULL."""
    return ~normal_code(column).isin(*allowed)


def bad_identifier(column: Column) -> Column:
    """Too long, or anything but digits; a blank value counts, NULL does not."""
    trimmed = F.trim(column)
    return longer_than(column, contracts.ID_MAX_LENGTH) | ~trimmed.rlike(
        contracts.ID_PATTERN
    )


def status_rank(status: Column) -> Column:
    """How settled a transaction is; unknown statuses rank lowest."""
    normal = F.upper(status)
    rank = F.lit(0)
    for name, value in contracts.STATUS_RANK.items():
        rank = F.when(normal == name, F.lit(value)).otherwise(rank)
    return rank
