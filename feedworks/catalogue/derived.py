"""Feeds derived from the star-schema tables.

The tables hold no member files or redemption feeds, so both are built from
orders, customers and line items by fixed formulas that also plant every kind
of fault. Each feed carries at most two transactions, so nothing is gathered
per key and the work grows with the tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks import contracts
from feedworks.functions.dates import file_date
from feedworks.functions.once import computed_once

AS_OF = dt.date(2002, 1, 1)
FIRST_RUN = dt.datetime(2002, 1, 1, 1, 0)
SECOND_RUN = dt.datetime(2002, 1, 1, 2, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table stored in fewer blocks than there are cores.

    Only such small tables pay the exchange; a table of many files stays as its
    scan delivers it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(key: Column, cases: list[tuple[int, object]], otherwise: Column) -> Column:
    """The value of the first modulus that divides ``key``, else ``otherwise``."""
    value = None
    for modulus, result in cases:
        result = result if isinstance(result, Column) else F.lit(result)
        hit = key % modulus == 0
        value = F.when(hit, result) if value is None else value.when(hit, result)
    return value.otherwise(otherwise)


def _day(column: Column) -> Column:
    """``yyyyMMdd`` of a date. The formatter, which is costly, only sees years
    that have not four digits."""
    return F.when(
        F.year(column).between(1000, 9999),
        F.translate(column.cast("string"), "-", ""),
    ).otherwise(F.date_format(column, "yyyyMMdd"))


def member_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw line per order, in one file per order day."""
    day = _pick(F.col("k"), [(173, "undated")], _day(F.col("ordered")))
    path = F.concat(F.lit("incoming/member/profile_"), day, F.lit(".txt"))
    return _sent_lines(spark, sf_dir).select(
        path.alias("source_path"),
        "raw_record",
        file_date(path).alias("source_file_date"),
        F.lit(FIRST_RUN).alias("ingestion_time"),
    )


def _sent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_record`` of every order, with its key and day."""
    orders = spread(
        table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("k"),
            F.col("o_custkey").alias("c"),
            F.to_date("o_orderdate").alias("ordered"),
        )
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    joined = orders.join(customers, F.col("c") == F.col("c_custkey"))
    k, c, ordered = F.col("k"), F.col("c"), F.col("ordered")
    number = c.cast("string")
    born = F.date_add(F.lit(dt.date(1950, 1, 1)), (c * 17 % 18000).cast("int"))
    nation = F.col("c_nationkey") % 5
    country = (
        F.when(nation == 0, "USA")
        .when(nation == 1, "ind")
        .when(nation == 2, "AUS")
        .when(nation == 3, "PHL")
        .otherwise("CAN")
    )
    fields = [
        F.lit(""),
        _pick(k, [(101, "X")], F.lit("D")),
        _pick(k, [(61, ""), (67, "x" * 300)], F.col("c_name")),
        _pick(k, [(71, ""), (73, F.concat(F.lit("A"), number))], number),
        _pick(
            k,
            [(79, "20241301"), (83, ""), (89, "20990101")],
            _day(F.date_sub(ordered, (k % 3000).cast("int"))),
        ),
        _pick(
            k,
            [(97, "20240230"), (109, "20990101"), (113, "19000101"), (5, "")],
            _day(ordered),
        ),
        _pick(k, [(139, "PLATINUM")], F.substring("c_mktsegment", 1, 3)),
        _pick(
            k,
            [(149, "y" * 300)],
            F.concat(F.lit("Agent"), (k % 10).cast("string")),
        ),
        _pick(
            k, [(151, "TOOLONG")], F.concat(F.lit("S"), (k % 50).cast("string"))
        ),
        _pick(k, [(157, "")], country),
        _pick(
            k,
            [(127, "19851303"), (131, "20990101"), (137, "18000101")],
            F.when(k % 2 == 0, F.date_format(born, "MMddyyyy")).otherwise(_day(born)),
        ),
        _pick(
            k,
            [(163, "Z")],
            F.when(k % 3 == 0, "A").when(k % 3 == 1, "i").otherwise(""),
        ),
    ]
    details = F.concat_ws("|", *fields, F.when(k % 167 == 0, "extra"))
    line = _pick(k, [(107, contracts.MEMBER_HEADER), (103, "|H|WRONG")], details)
    return joined.select("k", "ordered", line.alias("raw_record"))


def redemption_feeds(
    spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One nested feed per line item, with none, one or two transactions.

    Feeds are dated to the end of the order's month. ``keep`` names columns of the
    line item to return too.
    """
    items = spread(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("k"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_linestatus").alias("linestatus"),
            F.to_date("l_shipdate").alias("shipped"),
        )
    )
    nothing = F.lit(None)
    # What a feed takes from its order alone is worked out once for each order, so
    # a filter on it is too, and not for each line item that the join pairs with it.
    key, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ordered = F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ordered.alias("ordered"),
        _pick(key, [(71, ""), (73, F.concat(F.lit("A"), c))], c).alias("member_id"),
        computed_once(
            _pick(
                key,
                [(79, "20241301"), (83, nothing), (89, "20990101")],
                _day(F.last_day(ordered)),
            )
        ).alias("feed_date"),
    )
    joined = items.join(orders, F.col("k") == F.col("o_orderkey")).withColumn(
        "h", F.col("k") * 7 + F.col("line") + F.col("part")
    )
    k, h = F.col("k"), F.col("h")
    txn_id = F.concat_ws("-", k, F.col("line"))
    first = F.struct(
        _pick(h, [(31, "")], txn_id).alias("txn_id"),
        _pick(h, [(37, "20240230"), (41, nothing)], _day(F.col("shipped"))).alias(
            "txn_date"
        ),
        _pick(
            h,
            [(43, ""), (47, "p" * 300)],
            F.concat(F.lit("Partner#"), (F.col("supplier") % 25).cast("string")),
        ).alias("partner"),
        _pick(
            h,
            [(53, nothing), (59, F.lit(-1).cast("bigint"))],
            (F.col("quantity") * 100).cast("bigint"),
        ).alias("miles_redeemed"),
        _pick(
            h,
            [(61, ""), (67, "REVERSED")],
            F.when(F.col("linestatus") == "F", "COMPLETED").otherwise("pending"),
        ).alias("status"),
    )
    settled = F.struct(
        F.concat(F.lit(" "), txn_id).alias("txn_id"),
        _day(F.col("ordered")).alias("txn_date"),
        F.lit("Settlement").alias("partner"),
        (F.col("quantity") * 10).cast("bigint").alias("miles_redeemed"),
        F.lit(" completed ").alias("status"),
    )
    absent = F.lit(None).cast(settled_type())
    none = F.array().cast(contracts.TRANSACTION_ARRAY)
    second = (
        F.when(h % 113 == 0, F.array(absent)).when(h % 3 == 0, F.array(settled)).otherwise(none)
    )
    # ``first`` stands here once: generated methods beyond 8,000 bytes of code, to
    # which a copy in every branch leads, are never compiled by the JVM.
    transactions = (
        F.when(k % 97 == 0, F.lit(None).cast(contracts.TRANSACTION_ARRAY))
        .when(h % 29 == 0, none)
        .otherwise(F.concat(F.array(first), second))
    )
    path = F.concat(
        F.lit("incoming/redemption/feed_"),
        F.concat_ws("_", k, F.col("line"), F.col("part"), F.col("supplier")),
        F.lit(".json"),
    )
    return joined.select(
        *[F.col(name) for name in keep],
        "member_id",
        "feed_date",
        computed_once(transactions).alias("redemptions"),
        F.when(k % 101 == 0, "{unreadable").alias("_corrupt_record"),
        path.alias("source_path"),
        F.lit(FIRST_RUN).alias("ingestion_time"),
    )


def settled_type() -> str:
    """The element type of the transaction array."""
    return contracts.TRANSACTION_ARRAY[len("ARRAY<") : -1]


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer attributes as of each order: many versions per customer."""
    return table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.to_date("o_orderdate").alias("order_day"),
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
    )


def item_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions; a settled one has line status F."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_linestatus") == "F", "COMPLETED")
        .otherwise("PENDING")
        .alias("status"),
        F.to_date("l_shipdate").alias("ship_day"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        "l_returnflag",
    )
