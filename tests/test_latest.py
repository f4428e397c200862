import datetime as dt

from pyspark.sql import functions as F

from feedworks.operators.latest import latest_per_key, newest_first
from feedworks.plans.members import latest_members
from feedworks.plans.redemptions import latest_transactions

COLUMNS = (
    "member_id STRING, txn_id STRING, feed_date DATE, txn_date DATE, partner STRING, "
    "miles_redeemed BIGINT, status STRING, source_path STRING, ingestion_time TIMESTAMP"
)


def txn(status, feed_day, hour=1, path="/a", miles=1, feed_month=1):
    day = feed_day and dt.date(2024, feed_month, feed_day)
    return (
        "1", "T", day, dt.date(2024, 1, 1), "P", miles, status, path,
        dt.datetime(2024, 2, 1, hour),
    )


def winner(spark, *rows):
    df = spark.createDataFrame(list(rows), COLUMNS)
    found = latest_transactions(df).collect()
    assert len(found) == 1
    return found[0]


def test_completed_beats_a_later_pending(spark):
    assert winner(spark, txn("PENDING", 20), txn("COMPLETED", 15)).status == "COMPLETED"


def test_then_feed_date_then_run_then_path(spark):
    assert winner(spark, txn("PENDING", 1), txn("PENDING", 2)).feed_date.day == 2
    assert winner(spark, txn("PENDING", None), txn("PENDING", 2)).feed_date.day == 2
    assert winner(spark, txn("PENDING", 1, 5), txn("PENDING", 1, 6)).ingestion_time.hour == 6
    assert winner(spark, txn("PENDING", 1, path="/a"), txn("PENDING", 1, path="/b")).source_path == "/b"


def test_full_ties_have_one_fixed_winner(spark):
    rows = [txn("PENDING", 1, miles=m) for m in (3, 9, 5)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, COLUMNS).repartition(3)
        assert latest_transactions(df).first().miles_redeemed == 9


def test_null_is_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    latest = latest_per_key(df, ["k"], newest_first([F.col("v")]))
    assert {tuple(r) for r in latest.collect()} == {(None, 2), ("a", 1)}


def test_latest_member_by_file_date(spark):
    df = spark.createDataFrame(
        [
            ("1", dt.date(2024, 1, 1), dt.datetime(2024, 1, 9), "/a", "old"),
            ("1", dt.date(2024, 1, 2), dt.datetime(2024, 1, 3), "/b", "new"),
        ],
        "mem_id string, source_file_date date, ingestion_time timestamp, "
        "source_path string, name string",
    )
    assert latest_members(df).first().name == "new"
