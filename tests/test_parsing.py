import datetime as dt

from pyspark.sql import functions as F

from feedworks.operators.delimited import Field, decode, split_record
from feedworks.operators.flatten import explode_feed, item


def test_split_keeps_trailing_empty_fields(spark):
    lines = ["|D|a||", "", "no delimiter", "|H", "|X|1"]
    df = spark.createDataFrame([(x,) for x in lines], "raw_record string")
    found = [
        (r.record_type, r.field_count)
        for r in split_record(df).select("record_type", "field_count").collect()
    ]
    assert found == [("D", 5), (None, 1), (None, 1), ("H", 2), ("X", 3)]


def test_split_takes_any_delimiter(spark):
    df = spark.createDataFrame([(".D.1",)], "raw_record string")
    assert split_record(df, delimiter=".").first().field_count == 3


def test_decode_types_and_keeps_text(spark):
    df = spark.createDataFrame([("|D| x |20240131| gb",)], "raw_record string")
    row = decode(
        split_record(df),
        [
            Field("name", 2),
            Field("day", 3, formats=("yyyyMMdd",)),
            Field("country", 4, upper=True),
            Field("beyond", 9),
        ],
        ["record_type"],
    ).first()
    assert row.asDict() == {
        "record_type": "D", "name": "x", "day_raw": "20240131", "country": "GB",
        "beyond": None, "day": dt.date(2024, 1, 31),
    }


def test_flatten_drops_empty_and_keeps_null_elements(spark):
    df = spark.createDataFrame(
        [(1, [("a",), None]), (2, []), (3, None)],
        "id int, items array<struct<x: string>>",
    )
    flat = explode_feed(df, "items", ["id"], {"x": F.upper(item("x"))}, "at")
    assert sorted(map(tuple, flat.collect()), key=str) == [(1, 0, "A"), (1, 1, None)]
    assert explode_feed(df, "items", ["id"], {"x": item("x")}).columns == ["id", "x"]
