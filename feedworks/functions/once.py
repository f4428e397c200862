"""Keep a costly column from being worked out more than once per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(column: Column) -> Column:
    """``column``, out of the optimizer's reach for filters that test it.

    A filter on a computed column is normally moved below the computation with
    the whole expression copied into it. For a cheap test on the outcome of an
    expensive parse that doubles the parse, and each filtered step on top
    doubles it again. Spark does not move a filter below the generator its
    column comes from, so the value goes through a one-element ``explode``,
    which stays inside generated code. One per ``select`` or ``withColumn``.
    """
    return F.explode(F.array(column))
