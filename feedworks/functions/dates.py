"""Date parsing and date-derived attributes.

"Today" is always an argument, so a rerun or a backfill gives the same rows.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedworks import contracts


_SHAPES = {
    "yyyy": "(?!0000)[0-9]{4}",
    "MM": "(0[1-9]|1[0-2])",
    "dd": "(0[1-9]|[12][0-9]|3[01])",
}


def parse_date(column: Column, *formats: str) -> Column:
    """First format that fits, else NULL; bad text never fails the job."""
    attempts = [_attempt(column, fmt) for fmt in formats]
    return attempts[0] if len(attempts) == 1 else F.coalesce(*attempts)


def _attempt(column: Column, fmt: str) -> Column:
    """The result of ``try_to_date``, at a lower price for all-digit formats.

    A formatter is costly, and most of all when it fails: Spark then handles an
    exception per row. Text of the right digits is therefore cut up and cast,
    digits that cannot be a date in this format are not tried, and only other
    text is left to the formatter.
    """
    general = F.try_to_date(column, fmt)
    if sorted(re.findall("yyyy|MM|dd|.", fmt)) != sorted(_SHAPES):
        return general
    shape = re.sub("yyyy|MM|dd", lambda part: _SHAPES[part.group()], fmt)
    parts = [
        F.substring(column, fmt.index(part) + 1, len(part)) for part in _SHAPES
    ]
    return F.when(
        column.rlike(f"^{shape}\\z"), F.concat_ws("-", *parts).try_cast("date")
    ).when(~column.rlike(r"^[0-9]{8}\z"), general)


def file_date(path: Column) -> Column:
    """Business date from the text after the last ``_`` of a file's stem."""
    suffix = F.regexp_extract(path, r"([^_/]*)[.][^./]*$", 1)
    return F.try_to_date(suffix, contracts.FEED_DATE_FORMAT)


def unreadable_date(raw: Column, parsed: Column) -> Column:
    """Something was sent, but it is not a date."""
    return (F.trim(raw) != "") & parsed.isNull()


def age_years(born: Column, as_of: dt.date) -> Column:
    """Completed years on ``as_of``."""
    months = F.months_between(F.lit(as_of), born)
    return F.floor(months / F.lit(12)).cast("int")


def is_stale(last_flight: Column, as_of: dt.date) -> Column:
    """Flew, but too long ago; never flown is not stale."""
    idle = F.datediff(F.lit(as_of), last_flight)
    return F.coalesce(idle > contracts.STALE_AFTER_DAYS, F.lit(False))
