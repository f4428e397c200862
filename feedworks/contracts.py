"""The values that both feeds agree on with their producers and consumers.

Everything here is a fixed value: header text, code lists, date formats and
table columns must be exactly these for results to be right.
"""

# --- fixed values: member file -------------------------------------------------
MEMBER_HEADER = (
    "|H|Member_Name|Member_Id|Enrollment_Date|Last_Flight_Date|Tier_Code|"
    "Agent_Name|State|Country|DOB|Is_Active"
)
MEMBER_FIELD_COUNT = 12
HEADER_TYPE = "H"
DETAIL_TYPE = "D"
FEED_DATE_FORMAT = "yyyyMMdd"
BIRTH_DATE_FORMATS = ("yyyyMMdd", "MMddyyyy")

# --- fixed values: code lists and limits ---------------------------------------
COUNTRIES = ("USA", "IND", "AUS", "PHL")
ACTIVE_FLAGS = ("A", "I")
STATUS_RANK = {"COMPLETED": 2, "PENDING": 1}
ID_PATTERN = r"^[0-9]+$"
ID_MAX_LENGTH = 18
NAME_MAX_LENGTH = 255
CODE_MAX_LENGTH = 5
MAX_AGE = 120
STALE_AFTER_DAYS = 90

# --- fixed values: table columns -----------------------------------------------
LEDGER = "source_path STRING, ingestion_time TIMESTAMP"

MEMBER_RAW = (
    "source_path STRING, raw_record STRING, source_file_date DATE, "
    "ingestion_time TIMESTAMP"
)
MEMBER_STAGING = (
    "source_path STRING, ingestion_time TIMESTAMP, source_file_date DATE, "
    "name STRING, mem_id STRING, enroll_dt DATE, flight_dt DATE, tier STRING, "
    "agent_name STRING, state STRING, country_code STRING, dob DATE, "
    "flag STRING, age INT, stale_member BOOLEAN"
)
MEMBER_TARGET = (
    "mem_id STRING, name STRING, enroll_dt DATE, flight_dt DATE, tier STRING, "
    "agent_name STRING, state STRING, country_code STRING, dob DATE, "
    "flag STRING, age INT, stale_member BOOLEAN, source_path STRING, "
    "ingestion_time TIMESTAMP, source_file_date DATE"
)
MEMBER_QUARANTINE = (
    "source_path STRING, raw_record STRING, source_file_date DATE, "
    "ingestion_time TIMESTAMP, record_type STRING, field_count INT, "
    "name STRING, mem_id STRING, enroll_dt_raw STRING, flight_dt_raw STRING, "
    "tier STRING, agent_name STRING, state STRING, country_code STRING, "
    "dob_raw STRING, flag STRING, enroll_dt DATE, flight_dt DATE, dob DATE, "
    "validation_errors ARRAY<STRING>, validation_time TIMESTAMP"
)
COUNTRY_TABLE = (
    "mem_id STRING, name STRING, enroll_dt DATE, flight_dt DATE, tier STRING, "
    "agent_name STRING, state STRING, country_code STRING, dob DATE, "
    "flag STRING, age INT, stale_member BOOLEAN"
)
TRANSACTION_ARRAY = (
    "ARRAY<STRUCT<txn_id: STRING, txn_date: STRING, partner: STRING, "
    "miles_redeemed: BIGINT, status: STRING>>"
)
REDEMPTION_FEED = (
    f"member_id STRING, feed_date STRING, redemptions {TRANSACTION_ARRAY}, "
    "_corrupt_record STRING"
)
REDEMPTION_TARGET = (
    "member_id STRING, txn_id STRING, feed_date DATE, txn_date DATE, "
    "partner STRING, miles_redeemed BIGINT, status STRING, "
    "source_path STRING, ingestion_time TIMESTAMP"
)
REDEMPTION_QUARANTINE = (
    "source_path STRING, member_id STRING, feed_date_raw STRING, "
    "feed_date DATE, txn_id STRING, txn_date_raw STRING, txn_date DATE, "
    "partner STRING, miles_redeemed BIGINT, status STRING, "
    f"_corrupt_record STRING, redemptions {TRANSACTION_ARRAY}, "
    "ingestion_time TIMESTAMP, validation_errors ARRAY<STRING>, "
    "validation_time TIMESTAMP"
)

MANIFEST = "source_path STRING, path STRING"

MEMBER_KEY = ("mem_id",)
TRANSACTION_KEY = ("member_id", "txn_id")

# Attributes a transaction takes from its member in the enrichment view.
MEMBER_ATTRIBUTES = (
    "name", "enroll_dt", "flight_dt", "tier", "agent_name", "state",
    "country_code", "dob", "flag", "age", "stale_member",
)
TRANSACTION_FACTS = (
    "member_id", "txn_id", "feed_date", "txn_date", "partner",
    "miles_redeemed", "status",
)


def column_names(ddl: str) -> list[str]:
    """Column names of one of the DDL strings above, in order."""
    flat, depth = "", 0
    for char in ddl:
        depth += (char in "<(") - (char in ">)")
        flat += char if depth == 0 else ""
    return [column.split()[0] for column in flat.split(",")]
