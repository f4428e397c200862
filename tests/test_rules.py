"""Each of the 47 rules, firing and not firing, and how codes combine."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedworks.operators.rules import Rule, route, with_errors
from feedworks.plans.member_rules import line_rules, member_rules
from feedworks.plans.redemption_rules import feed_rules, transaction_rules

AS_OF = dt.date(2024, 1, 20)
DAY = dt.date(2024, 1, 15)
FUTURE = dt.date(2024, 1, 21)

LINE = {
    "columns": "source_file_date DATE, raw_record STRING, record_type STRING, field_count INT",
    "good": {
        "source_file_date": DAY, "raw_record": "|D|x", "record_type": "D",
        "field_count": 12,
    },
    "rules": lambda: line_rules("|H|head"),
}
MEMBER = {
    "columns": (
        "source_file_date DATE, field_count INT, name STRING, mem_id STRING, "
        "enroll_dt_raw STRING, enroll_dt DATE, flight_dt_raw STRING, flight_dt DATE, "
        "tier STRING, agent_name STRING, state STRING, country_code STRING, "
        "dob_raw STRING, dob DATE, flag STRING"
    ),
    "good": {
        "source_file_date": DAY, "field_count": 12, "name": "Nora Quist",
        "mem_id": "200000000001", "enroll_dt_raw": "20200301",
        "enroll_dt": dt.date(2020, 3, 1), "flight_dt_raw": "20231201",
        "flight_dt": dt.date(2023, 12, 1), "tier": "SLV", "agent_name": "Ines",
        "state": "WA", "country_code": "USA", "dob_raw": "19900228",
        "dob": dt.date(1990, 2, 28), "flag": "A",
    },
    "rules": lambda: member_rules(AS_OF),
}
FEED = {
    "columns": (
        "_corrupt_record STRING, member_id STRING, feed_date_raw STRING, "
        "feed_date DATE, redemptions ARRAY<STRING>"
    ),
    "good": {
        "_corrupt_record": None, "member_id": "7", "feed_date_raw": "20240115",
        "feed_date": DAY, "redemptions": [],
    },
    "rules": lambda: feed_rules(AS_OF),
}
ROW = {
    "columns": (
        "feed_date_raw STRING, feed_date DATE, member_id STRING, txn_id STRING, "
        "txn_date_raw STRING, txn_date DATE, partner STRING, miles_redeemed BIGINT, "
        "status STRING"
    ),
    "good": {
        "feed_date_raw": "20240115", "feed_date": DAY, "member_id": "7",
        "txn_id": "T1", "txn_date_raw": "20240115", "txn_date": DAY,
        "partner": "Hotel", "miles_redeemed": 0, "status": "PENDING",
    },
    "rules": lambda: transaction_rules(AS_OF),
}

# level, changed values, every code expected, in order
CASES = [
    (LINE, {"source_file_date": None}, ["INVALID_SOURCE_FILE_DATE"]),
    (LINE, {"record_type": "X"}, ["INVALID_RECORD_TYPE"]),
    (LINE, {"record_type": None}, ["INVALID_RECORD_TYPE"]),
    (LINE, {"record_type": ""}, ["INVALID_RECORD_TYPE"]),
    (LINE, {"record_type": " D"}, ["INVALID_RECORD_TYPE"]),
    (LINE, {"record_type": "H", "raw_record": "|H|other"}, ["INVALID_MEMBER_HEADER"]),
    (LINE, {"record_type": "H", "raw_record": " |H|head "}, []),
    (LINE, {"record_type": "H", "raw_record": "|H|head", "field_count": 3}, []),
    (LINE, {"field_count": 13}, ["INVALID_MEMBER_FIELD_COUNT"]),
    (
        LINE,
        {"field_count": 11, "source_file_date": None},
        ["INVALID_SOURCE_FILE_DATE", "INVALID_MEMBER_FIELD_COUNT"],
    ),
    (MEMBER, {"source_file_date": None}, ["INVALID_SOURCE_FILE_DATE"]),
    (MEMBER, {"field_count": 13}, ["INVALID_MEMBER_FIELD_COUNT"]),
    (MEMBER, {"name": None}, ["MISSING_MEMBER_NAME"]),
    (MEMBER, {"name": "  "}, ["MISSING_MEMBER_NAME"]),
    (MEMBER, {"name": "n" * 256}, ["MEMBER_NAME_TOO_LONG"]),
    (MEMBER, {"name": "n" * 255}, []),
    (MEMBER, {"mem_id": None}, ["MISSING_MEMBER_ID"]),
    (MEMBER, {"mem_id": " "}, ["MISSING_MEMBER_ID", "INVALID_MEMBER_ID"]),
    (MEMBER, {"mem_id": "12A"}, ["INVALID_MEMBER_ID"]),
    (MEMBER, {"mem_id": "1" * 19}, ["INVALID_MEMBER_ID"]),
    (MEMBER, {"mem_id": "1" * 18}, []),
    (
        MEMBER,
        {"enroll_dt_raw": "20201301", "enroll_dt": None},
        ["INVALID_ENROLLMENT_DATE", "MISSING_ENROLLMENT_DATE"],
    ),
    (
        MEMBER,
        {"enroll_dt_raw": None, "enroll_dt": None},
        ["MISSING_ENROLLMENT_DATE"],
    ),
    (
        MEMBER,
        {"enroll_dt_raw": " ", "enroll_dt": None},
        ["MISSING_ENROLLMENT_DATE"],
    ),
    (
        MEMBER,
        {"enroll_dt": FUTURE, "flight_dt": None, "flight_dt_raw": None},
        ["FUTURE_ENROLLMENT_DATE"],
    ),
    (
        MEMBER,
        {"enroll_dt": AS_OF, "flight_dt": None, "flight_dt_raw": None},
        [],
    ),
    (
        MEMBER,
        {"flight_dt_raw": "20240230", "flight_dt": None},
        ["INVALID_LAST_FLIGHT_DATE"],
    ),
    (MEMBER, {"flight_dt_raw": None, "flight_dt": None}, []),
    (MEMBER, {"flight_dt": FUTURE}, ["FUTURE_LAST_FLIGHT_DATE"]),
    (MEMBER, {"flight_dt": dt.date(2020, 2, 29)}, ["FLIGHT_BEFORE_ENROLLMENT"]),
    (MEMBER, {"flight_dt": dt.date(2020, 3, 1)}, []),
    (MEMBER, {"dob_raw": "19901340", "dob": None}, ["INVALID_DATE_OF_BIRTH"]),
    (MEMBER, {"dob_raw": None, "dob": None}, []),
    (
        MEMBER,
        {"dob": FUTURE},
        ["FUTURE_DATE_OF_BIRTH", "IMPLAUSIBLE_MEMBER_AGE"],
    ),
    (MEMBER, {"dob": dt.date(1903, 1, 20)}, ["IMPLAUSIBLE_MEMBER_AGE"]),
    (MEMBER, {"dob": dt.date(1903, 1, 21)}, []),
    (MEMBER, {"tier": "SILVER"}, ["TIER_CODE_TOO_LONG"]),
    (MEMBER, {"tier": None}, []),
    (MEMBER, {"agent_name": "a" * 256}, ["AGENT_NAME_TOO_LONG"]),
    (MEMBER, {"state": "STATES"}, ["STATE_TOO_LONG"]),
    (MEMBER, {"country_code": None}, ["MISSING_COUNTRY_CODE"]),
    (
        MEMBER,
        {"country_code": ""},
        ["MISSING_COUNTRY_CODE", "UNSUPPORTED_COUNTRY_CODE"],
    ),
    (MEMBER, {"country_code": "CAN"}, ["UNSUPPORTED_COUNTRY_CODE"]),
    (MEMBER, {"country_code": " ind "}, []),
    (MEMBER, {"flag": "Z"}, ["INVALID_ACTIVE_MEMBER_FLAG"]),
    (MEMBER, {"flag": "i"}, []),
    (MEMBER, {"flag": " "}, []),
    (MEMBER, {"flag": None}, []),
    (FEED, {"_corrupt_record": "{"}, ["INVALID_REDEMPTION_JSON"]),
    (FEED, {"member_id": None}, ["MISSING_MEMBER_ID"]),
    (FEED, {"member_id": ""}, ["MISSING_MEMBER_ID", "INVALID_MEMBER_ID"]),
    (FEED, {"member_id": "A1"}, ["INVALID_MEMBER_ID"]),
    (FEED, {"member_id": " 1 "}, []),
    (FEED, {"feed_date_raw": None, "feed_date": None}, ["MISSING_FEED_DATE"]),
    (FEED, {"feed_date_raw": "20241301", "feed_date": None}, ["INVALID_FEED_DATE"]),
    (FEED, {"feed_date": FUTURE}, ["FUTURE_FEED_DATE"]),
    (FEED, {"redemptions": None}, ["MISSING_REDEMPTIONS_ARRAY"]),
    (
        ROW,
        {"feed_date_raw": "x", "feed_date": None},
        ["INVALID_FEED_DATE", "MISSING_FEED_DATE"],
    ),
    (ROW, {"feed_date_raw": None, "feed_date": None}, ["MISSING_FEED_DATE"]),
    (ROW, {"feed_date": FUTURE}, ["FUTURE_FEED_DATE"]),
    (ROW, {"member_id": None}, ["MISSING_MEMBER_ID"]),
    (ROW, {"member_id": ""}, ["MISSING_MEMBER_ID", "INVALID_MEMBER_ID"]),
    (ROW, {"member_id": "1-1"}, ["INVALID_MEMBER_ID"]),
    (ROW, {"txn_id": " "}, ["MISSING_TRANSACTION_ID"]),
    (
        ROW,
        {"txn_date_raw": "20240230", "txn_date": None},
        ["INVALID_TRANSACTION_DATE", "MISSING_TRANSACTION_DATE"],
    ),
    (ROW, {"txn_date_raw": None, "txn_date": None}, ["MISSING_TRANSACTION_DATE"]),
    (ROW, {"txn_date": dt.date(2024, 1, 16)}, ["TRANSACTION_AFTER_FEED_DATE"]),
    (ROW, {"partner": None}, ["MISSING_PARTNER"]),
    (ROW, {"partner": "p" * 256}, ["PARTNER_TOO_LONG"]),
    (ROW, {"miles_redeemed": None}, ["MISSING_MILES_REDEEMED"]),
    (ROW, {"miles_redeemed": -1}, ["NEGATIVE_MILES_REDEEMED"]),
    (ROW, {"status": None}, ["MISSING_REDEMPTION_STATUS"]),
    (ROW, {"status": ""}, ["MISSING_REDEMPTION_STATUS"]),
    (ROW, {"status": "REVERSED"}, ["INVALID_REDEMPTION_STATUS"]),
    (ROW, {"status": "completed"}, []),
]


@pytest.mark.parametrize("level", [LINE, MEMBER, FEED, ROW])
def test_each_rule_fires_exactly_when_it_should(spark, level):
    cases = [(changes, codes) for at, changes, codes in CASES if at is level]
    names = [column.split()[0] for column in level["columns"].split(", ")]
    rows = [({**level["good"]}, []), *[({**level["good"], **c}, e) for c, e in cases]]
    df = spark.createDataFrame(
        [(i, *[row[n] for n in names]) for i, (row, _) in enumerate(rows)],
        f"case INT, {level['columns']}",
    )
    found = {
        row.case: row.validation_errors
        for row in with_errors(df, level["rules"]()).collect()
    }
    assert found == {i: expected for i, (_, expected) in enumerate(rows)}


def test_the_cases_cover_every_rule():
    tried = {
        (id(level), code) for level, _, codes in CASES for code in codes
    }
    assert len(tried) == 47


def test_routing_splits_without_loss(spark):
    df = spark.range(20)
    rules = [Rule("LOW", F.col("id") < 5), Rule("EVEN", F.col("id") % 2 == 0)]
    routed = route(df, rules)
    good = {row.id for row in routed.valid.collect()}
    bad = {row.id: row.validation_errors for row in routed.invalid.collect()}
    assert good == {i for i in range(5, 20) if i % 2}
    assert bad[4] == ["LOW", "EVEN"] and bad[3] == ["LOW"] and bad[6] == ["EVEN"]
    assert good | set(bad) == set(range(20))
    assert routed.valid.columns == ["id"]


def test_one_code_from_two_rules_is_listed_once_in_first_place(spark):
    rules = [
        Rule("A", F.col("id") == 1),
        Rule("B", F.lit(True)),
        Rule("A", F.col("id") == 2),
    ]
    found = [r[1] for r in with_errors(spark.range(3), rules).orderBy("id").collect()]
    assert found == [["B"], ["A", "B"], ["A", "B"]]


def test_a_null_condition_does_not_fire(spark):
    rules = [Rule("A", F.lit(None).cast("boolean"))]
    assert with_errors(spark.range(1), rules).first().validation_errors == []


def test_codes_must_be_separable():
    with pytest.raises(ValueError):
        Rule("A,B", None)
