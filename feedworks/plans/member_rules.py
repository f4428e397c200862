"""Checks on member files: first on lines, then on decoded rows.

The codes and their order are fixed values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from feedworks import contracts
from feedworks.functions.dates import age_years, unreadable_date
from feedworks.functions.text import (
    bad_identifier,
    is_blank,
    longer_than,
    outside,
)
from feedworks.operators.rules import Rule


def line_rules(header: str = contracts.MEMBER_HEADER) -> list[Rule]:
    kind = F.col("record_type")
    known = kind.isin(contracts.HEADER_TYPE, contracts.DETAIL_TYPE)
    is_header = kind == contracts.HEADER_TYPE
    is_detail = kind == contracts.DETAIL_TYPE
    wrong_count = F.col("field_count") != contracts.MEMBER_FIELD_COUNT
    return [
        Rule("INVALID_SOURCE_FILE_DATE", F.col("source_file_date").isNull()),
        Rule("INVALID_RECORD_TYPE", ~F.coalesce(known, F.lit(False))),
        Rule("INVALID_MEMBER_HEADER", is_header & (F.trim("raw_record") != header)),
        Rule("INVALID_MEMBER_FIELD_COUNT", is_detail & wrong_count),
    ]


def member_rules(as_of: dt.date) -> list[Rule]:
    today = F.lit(as_of)
    enrolled, flew, born = F.col("enroll_dt"), F.col("flight_dt"), F.col("dob")
    country, flag = F.col("country_code"), F.col("flag")
    age = age_years(born, as_of)
    return [
        Rule("INVALID_SOURCE_FILE_DATE", F.col("source_file_date").isNull()),
        Rule(
            "INVALID_MEMBER_FIELD_COUNT",
            F.col("field_count") != contracts.MEMBER_FIELD_COUNT,
        ),
        Rule("MISSING_MEMBER_NAME", is_blank(F.col("name"))),
        Rule(
            "MEMBER_NAME_TOO_LONG",
            longer_than(F.col("name"), contracts.NAME_MAX_LENGTH),
        ),
        Rule("MISSING_MEMBER_ID", is_blank(F.col("mem_id"))),
        Rule("INVALID_MEMBER_ID", bad_identifier(F.col("mem_id"))),
        Rule(
            "INVALID_ENROLLMENT_DATE",
            unreadable_date(F.col("enroll_dt_raw"), enrolled),
        ),
        Rule("MISSING_ENROLLMENT_DATE", enrolled.isNull()),
        Rule("FUTURE_ENROLLMENT_DATE", enrolled > today),
        Rule(
            "INVALID_LAST_FLIGHT_DATE",
            unreadable_date(F.col("flight_dt_raw"), flew),
        ),
        Rule("FUTURE_LAST_FLIGHT_DATE", flew > today),
        Rule("FLIGHT_BEFORE_ENROLLMENT", flew < enrolled),
        Rule("INVALID_DATE_OF_BIRTH", unreadable_date(F.col("dob_raw"), born)),
        Rule("FUTURE_DATE_OF_BIRTH", born > today),
        Rule("IMPLAUSIBLE_MEMBER_AGE", ~age.between(0, contracts.MAX_AGE)),
        Rule(
            "TIER_CODE_TOO_LONG",
            longer_than(F.col("tier"), contracts.CODE_MAX_LENGTH),
        ),
        Rule(
            "AGENT_NAME_TOO_LONG",
            longer_than(F.col("agent_name"), contracts.NAME_MAX_LENGTH),
        ),
        Rule(
            "STATE_TOO_LONG",
            longer_than(F.col("state"), contracts.CODE_MAX_LENGTH),
        ),
        Rule("MISSING_COUNTRY_CODE", is_blank(country)),
        Rule("UNSUPPORTED_COUNTRY_CODE", outside(country, contracts.COUNTRIES)),
        Rule(
            "INVALID_ACTIVE_MEMBER_FLAG",
            ~is_blank(flag) & outside(flag, contracts.ACTIVE_FLAGS),
        ),
    ]
