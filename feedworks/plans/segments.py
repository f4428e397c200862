"""Country tables and country files."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from feedworks import contracts
from feedworks.sinks.exports import (
    ExportColumn,
    Segment,
    export_segments,
    fan_out,
    register_segments,
)

# --- fixed values: file layouts agreed with each country ------------------------
COMPACT_DATE = "Mddyyyy"
SLASH_DATE = "M/dd/yyyy"
ISO_DATE = "yyyy-MM-dd"

USA_FILE = (
    ExportColumn("mem_id", "ID"),
    ExportColumn("name", "Name"),
    ExportColumn("tier", "TierCode"),
    ExportColumn("enroll_dt", "EnrollmentDate", COMPACT_DATE),
)
INDIA_FILE = (
    ExportColumn("mem_id", "ID"),
    ExportColumn("name", "Name"),
    ExportColumn("dob", "DOB", SLASH_DATE),
    ExportColumn("tier", "TierCode"),
    ExportColumn("enroll_dt", "EnrollmentDate", COMPACT_DATE),
    ExportColumn(None, "Individual or Corporate"),
    ExportColumn("flight_dt", "Flight Date", COMPACT_DATE),
)
AUSTRALIA_FILE = (
    ExportColumn("mem_id", "Unique ID"),
    ExportColumn("name", "Member Name"),
    ExportColumn("tier", "Tier Type"),
    ExportColumn("dob", "Date of Birth", ISO_DATE),
    ExportColumn("enroll_dt", "Date of Enrollment", ISO_DATE),
    ExportColumn("flight_dt", "Date of Flight", ISO_DATE),
)
SEGMENTS = (
    Segment("USA", "usa", "member_profile_usa", USA_FILE),
    Segment("IND", "india", "member_profile_india", INDIA_FILE),
    Segment("AUS", "australia", "member_profile_australia", AUSTRALIA_FILE),
    Segment("PHL", "philippines", "member_profile_philippines"),
)


def write_country_tables(
    members: DataFrame, root: str, only: Collection[str] | None = None
) -> None:
    """All country tables, or those of the countries in ``only``."""
    fan_out(
        members,
        root,
        "country_code",
        SEGMENTS,
        contracts.column_names(contracts.COUNTRY_TABLE),
        only,
    )


def register_country_tables(spark: SparkSession, root: str) -> None:
    register_segments(spark, root, SEGMENTS, contracts.COUNTRY_TABLE)


def write_country_files(members: DataFrame, root: str) -> list[str]:
    """Returns the countries that have no agreed file layout."""
    return export_segments(members, root, "country_code", SEGMENTS)
