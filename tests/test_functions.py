import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedworks.contracts import MEMBER_TARGET, REDEMPTION_QUARANTINE, column_names
from feedworks.functions.dates import age_years, file_date, is_stale, parse_date
from feedworks.functions.text import clean, status_rank


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("20240229", dt.date(2024, 2, 29)),
        ("20230229", None),
        ("05031985", dt.date(1985, 5, 3)),
        ("13011985", None),
        ("20241301", None),
        (" 20240101", None),
        ("20240101 ", None),
        ("2024-01-01", None),
        ("2024101", None),
        ("", None),
        ("0", None),
        (None, None),
        ("abcdefgh", None),
    ],
)
def test_parse_date(spark, text, expected):
    assert one(spark, text, parse_date(F.col("v"), "yyyyMMdd", "MMddyyyy")) == expected


def test_skipping_hopeless_text_changes_no_result(spark):
    """Against plain attempts, on every month and day in both orders."""
    texts = [
        f"{a:02d}{b:02d}{y}" for a in range(0, 40) for b in (0, 1, 12, 13, 29, 31)
        for y in (1900, 1985, 2012)
    ]
    texts += [t[4:] + t[:4] for t in texts] + ["+120240115", "-20240115", "120240115"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    plain = F.coalesce(F.try_to_date("v", "yyyyMMdd"), F.try_to_date("v", "MMddyyyy"))
    ours = parse_date(F.col("v"), "yyyyMMdd", "MMddyyyy")
    assert df.filter(~plain.eqNullSafe(ours)).isEmpty()


@pytest.mark.parametrize(
    "path, expected",
    [
        ("file:/in/member_profile_20240115.txt", dt.date(2024, 1, 15)),
        ("/in/20240115.txt", dt.date(2024, 1, 15)),
        ("/in_20240115/members.txt", None),
        ("/in/a_b_20241340.txt", None),
        ("/in/a_20240115_x.txt", None),
        ("/in/a_2024.01.15.txt", None),
    ],
)
def test_file_date(spark, path, expected):
    assert one(spark, path, file_date(F.col("v"))) == expected


@pytest.mark.parametrize(
    "born, on, years",
    [
        (dt.date(2004, 2, 29), dt.date(2023, 2, 28), 19),
        (dt.date(2004, 2, 29), dt.date(2023, 2, 27), 18),
        (dt.date(1985, 5, 3), dt.date(2024, 5, 2), 38),
        (dt.date(1985, 5, 3), dt.date(2024, 5, 3), 39),
        (dt.date(2024, 5, 4), dt.date(2024, 5, 3), -1),
        (None, dt.date(2024, 5, 3), None),
    ],
)
def test_age(spark, born, on, years):
    assert one(spark, born, age_years(F.col("v"), on), "date") == years


@pytest.mark.parametrize(
    "flew, stale",
    [(dt.date(2024, 1, 1), False), (dt.date(2023, 12, 31), True), (None, False)],
)
def test_stale_after_ninety_days(spark, flew, stale):
    on = dt.date(2024, 3, 31)
    assert one(spark, flew, is_stale(F.col("v"), on), "date") is stale


def test_clean_trims_spaces_only(spark):
    assert one(spark, "  a b ", clean(F.col("v"))) == "a b"
    assert one(spark, "   ", clean(F.col("v"))) is None
    assert one(spark, "\t", clean(F.col("v"))) == "\t"


@pytest.mark.parametrize(
    "status, rank", [("COMPLETED", 2), ("completed", 2), ("PENDING", 1), ("X", 0), (None, 0)]
)
def test_status_rank(spark, status, rank):
    assert one(spark, status, status_rank(F.col("v"))) == rank


def test_column_names_skip_nested_fields():
    assert len(column_names(MEMBER_TARGET)) == 15
    assert "redemptions" in column_names(REDEMPTION_QUARANTINE)
    assert "txn_date:" not in column_names(REDEMPTION_QUARANTINE)
