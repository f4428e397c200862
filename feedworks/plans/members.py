"""Member files to staging, quarantine and the member table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedworks import contracts
from feedworks.functions.dates import age_years, is_stale
from feedworks.operators.delimited import Field, decode, split_record
from feedworks.operators.latest import latest_per_key, newest_first, settle_ties
from feedworks.operators.rules import (
    ERRORS,
    LEVEL,
    Routed,
    is_accepted,
    is_rejected,
    route,
    with_level_errors,
)
from feedworks.plans.layout import member_recency
from feedworks.plans.member_rules import line_rules, member_rules

_DATE = (contracts.FEED_DATE_FORMAT,)

# Fixed positions of the member file.
MEMBER_FIELDS = (
    Field("name", 2),
    Field("mem_id", 3),
    Field("enroll_dt", 4, formats=_DATE),
    Field("flight_dt", 5, formats=_DATE),
    Field("tier", 6),
    Field("agent_name", 7),
    Field("state", 8),
    Field("country_code", 9, upper=True),
    Field("dob", 10, formats=contracts.BIRTH_DATE_FORMATS),
    Field("flag", 11, upper=True),
)
PROVENANCE = ("source_path", "raw_record", "ingestion_time", "source_file_date")


def check_lines(lines: DataFrame) -> Routed:
    """Raw lines by whether their structure is right."""
    routed = route(split_record(lines), line_rules())
    return Routed(routed.valid, routed.invalid.drop("fields"))


def decode_members(lines: DataFrame) -> DataFrame:
    """Detail lines of the right width, decoded.

    A detail line from a file without a date is decoded too: it is reported
    both as a line and as a row.
    """
    is_detail = F.col("record_type") == contracts.DETAIL_TYPE
    right_width = F.col("field_count") == contracts.MEMBER_FIELD_COUNT
    details = split_record(lines).filter(is_detail & right_width)
    return decode(details, MEMBER_FIELDS, [*PROVENANCE, "field_count"])


def check_members(lines: DataFrame, as_of: dt.date) -> Routed:
    return route(decode_members(lines), member_rules(as_of))


LINE, ROW = "line", "row"


def check_all(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Lines and the rows decoded from them with their errors, from one scan and
    one parse: a line gives a row of ``LEVEL`` line and, if it is a detail line of
    the right width, one of ``LEVEL`` row. Columns of the other level are NULL.
    """
    split = split_record(lines)
    is_detail = F.col("record_type") == contracts.DETAIL_TYPE
    right_width = F.col("field_count") == contracts.MEMBER_FIELD_COUNT
    levels = F.when(
        is_detail & right_width, F.array(F.lit(LINE), F.lit(ROW))
    ).otherwise(F.array(F.lit(LINE)))
    levelled = split.withColumn(LEVEL, F.explode(levels))
    own = F.col(LEVEL)
    parted = levelled.withColumns(
        {
            "fields": F.when(own == ROW, F.col("fields")),
            "record_type": F.when(own == LINE, F.col("record_type")),
        }
    )
    decoded = decode(
        parted, MEMBER_FIELDS, [*PROVENANCE, "record_type", "field_count", LEVEL]
    )
    rules = {LINE: line_rules(), ROW: member_rules(as_of)}
    return with_level_errors(decoded, rules)


def rejected_members(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Bad lines and bad rows under one set of columns."""
    return quarantined(check_all(lines, as_of))


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(is_rejected()).drop(LEVEL)


def accepted_members(checked: DataFrame) -> DataFrame:
    return checked.filter(is_accepted(ROW)).drop(LEVEL, ERRORS, "record_type")


def stage_members(valid: DataFrame, as_of: dt.date) -> DataFrame:
    """Valid rows with the attributes derived on the day they came in."""
    derived = valid.withColumns(
        {
            "age": age_years(F.col("dob"), as_of),
            "stale_member": is_stale(F.col("flight_dt"), as_of),
        }
    )
    return derived.select(*contracts.column_names(contracts.MEMBER_STAGING))


def latest_members(staged: DataFrame) -> DataFrame:
    """One row per member: latest file, then run, then path."""
    order = newest_first(member_recency(F.col))
    ranked = {"mem_id", "source_file_date", "ingestion_time", "source_path"}
    return latest_per_key(
        staged, contracts.MEMBER_KEY, order + settle_ties(staged, ranked)
    )
