"""One runnable query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks import contracts
from feedworks.catalogue import derived
from feedworks.catalogue.derived import AS_OF, FIRST_RUN, SECOND_RUN, table
from feedworks.catalogue.feed_files import (
    EMPTY_FEED,
    EMPTY_LINES,
    arrive,
    base_name,
    deliver,
    feed_files,
    member_files,
)
from feedworks.functions.dates import age_years, is_stale, parse_date
from feedworks.functions.text import status_rank
from feedworks.operators.delimited import split_record
from feedworks.operators.enrich import enrich_with_dimension
from feedworks.operators.latest import latest_per_key, newest_first
from feedworks.operators.quality import duplicate_keys, error_summary
from feedworks.operators.rules import ERRORS, LEVEL, is_rejected, with_errors
from feedworks.operators.upsert import ACTION, upsert
from feedworks.plans import members, redemptions, segments
from feedworks.plans.ddl import create_tables
from feedworks.plans.ingest import (
    apply_member_lines,
    apply_redemption_feeds,
    ingest_members,
    ingest_redemptions,
)
from feedworks.plans.layout import Layout
from feedworks.plans.member_rules import line_rules, member_rules
from feedworks.plans.profile import (
    BRIEF_ATTRIBUTES,
    VIEW,
    create_profile_view,
    member_redemption_profile,
)
from feedworks.plans.redemption_rules import feed_rules, transaction_rules
from feedworks.sinks.exports import export_view, write_csv
from feedworks.sinks.layers import Layer
from feedworks.sinks.targets import Target, write_partitioned
from feedworks.sources.files import not_processed
from feedworks.sources.storage import file_names, scratch_path
from feedworks.sources.tables import read_table, sql_scan
from feedworks.streaming.available_now import (
    run_available,
    stream_lines,
    stream_redemptions,
)

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _joined(errors: str = ERRORS):
    return F.concat_ws(",", errors).alias("codes")


# --- latest per key ---------------------------------------------------------------


def _latest_items(spark, sf_dir):
    order = newest_first(
        [status_rank(F.col("status"))]
        + [F.col(c) for c in ("ship_day", "l_partkey", "l_suppkey", "quantity")]
    )
    return latest_per_key(
        derived.item_transactions(spark, sf_dir).drop("l_returnflag"),
        ["l_orderkey", "l_linenumber"],
        order,
    )


def _latest_orders(df):
    order = newest_first([F.col("order_day"), F.col("o_orderkey")])
    return latest_per_key(df, ["o_custkey"], order)


@query
def latest_per_key_status(spark, sf_dir):
    return _latest_items(spark, sf_dir)


@query
def latest_per_key_recency(spark, sf_dir):
    return _latest_orders(derived.order_snapshots(spark, sf_dir))


# --- enrichment -------------------------------------------------------------------


@query
def enrich_left_join(spark, sf_dir):
    """Latest transactions with the owner and the owner's latest attributes."""
    owner = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    facts = enrich_with_dimension(
        _latest_items(spark, sf_dir),
        owner,
        "l_orderkey",
        "o_orderkey",
        ["l_orderkey", "l_linenumber", "ship_day", "quantity", "status"],
        ["o_custkey"],
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment"
    )
    latest = _latest_orders(derived.order_snapshots(spark, sf_dir))
    dimension = latest.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return enrich_with_dimension(
        facts,
        dimension,
        "o_custkey",
        "c_custkey",
        facts.columns,
        ["c_name", "c_mktsegment", "order_day", "o_orderstatus"],
    )


def _valid_members(spark, sf_dir):
    lines = derived.member_lines(spark, sf_dir)
    return members.stage_members(members.check_members(lines, AS_OF).valid, AS_OF)


def _valid_transactions(spark, sf_dir):
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    return redemptions.check_transactions(dated, AS_OF).valid


@query
def enrich_profile(spark, sf_dir):
    return member_redemption_profile(
        redemptions.latest_transactions(_valid_transactions(spark, sf_dir)),
        members.latest_members(_valid_members(spark, sf_dir)),
    )


@query
def enrich_profile_brief(spark, sf_dir):
    return member_redemption_profile(
        redemptions.latest_transactions(_valid_transactions(spark, sf_dir)),
        members.latest_members(_valid_members(spark, sf_dir)),
        BRIEF_ATTRIBUTES,
    )


# --- merges -----------------------------------------------------------------------


def _order_recency(column):
    return [column("order_day"), column("o_orderkey")]


def _item_recency(column):
    return [
        status_rank(column("status")),
        column("ship_day"),
        column("l_partkey"),
        column("l_suppkey"),
    ]


def _order_halves(spark, sf_dir):
    orders = derived.order_snapshots(spark, sf_dir)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return _latest_orders(orders.filter(urgent)), _latest_orders(
        orders.filter(~urgent)
    )


def _item_halves(spark, sf_dir):
    items = derived.item_transactions(spark, sf_dir)
    returned = F.col("l_returnflag") == "R"
    keys = ["l_orderkey", "l_linenumber"]

    def latest(df):
        order = newest_first([*_item_recency(F.col), F.col("quantity")])
        return latest_per_key(df.drop("l_returnflag"), keys, order)

    return latest(items.filter(returned)), latest(items.filter(~returned))


@query
def upsert_recency(spark, sf_dir):
    current, batch = _order_halves(spark, sf_dir)
    return upsert(current, batch, ["o_custkey"], _order_recency)


@query
def upsert_priority(spark, sf_dir):
    current, batch = _item_halves(spark, sf_dir)
    return upsert(current, batch, ["l_orderkey", "l_linenumber"], _item_recency)


@query
def upsert_actions(spark, sf_dir):
    current, batch = _item_halves(spark, sf_dir)
    merged = upsert(
        current,
        batch,
        ["l_orderkey", "l_linenumber"],
        _item_recency,
        with_action=True,
    )
    return merged.groupBy(ACTION).agg(F.count(F.lit(1)).alias("row_count"))


@query
def upsert_target(spark, sf_dir):
    """The merge on a stored, partitioned table."""
    current, batch = _item_halves(spark, sf_dir)
    target = Target(
        name="items",
        path=scratch_path(spark, "upsert-target"),
        columns=(
            "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, "
            "l_suppkey BIGINT, status STRING, ship_day DATE, quantity BIGINT"
        ),
        keys=("l_orderkey", "l_linenumber"),
        recency=_item_recency,
        partition_by="status",
    )
    target.apply(current)
    target.apply(batch)
    return target.read(spark)


# --- incremental sources ----------------------------------------------------------


@query
def incremental_anti_join(spark, sf_dir):
    """Events of the hours that the ledger, hours with an error, does not hold."""
    events = table(spark, sf_dir, "events").withColumn(
        "source_path", F.date_format("ts", "yyyyMMddHH")
    )
    ledger = events.filter(F.col("event_type") == "error").select("source_path")
    fresh = not_processed(events, ledger.distinct())
    return fresh.select("event_id", "user_id", "event_type", "source_path")


@query
def scan_by_path(spark, sf_dir):
    return sql_scan(spark, f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )


# --- parsing and flattening -------------------------------------------------------


@query
def split_fields(spark, sf_dir):
    split = split_record(derived.member_lines(spark, sf_dir))
    return split.select(
        "source_path", "raw_record", "source_file_date", "record_type",
        "field_count",
    )


@query
def parse_delimited(spark, sf_dir):
    decoded = members.decode_members(derived.member_lines(spark, sf_dir))
    return decoded.drop("raw_record", "ingestion_time")


@query
def parse_dates_multi(spark, sf_dir):
    decoded = members.decode_members(derived.member_lines(spark, sf_dir))
    return decoded.select(
        "mem_id",
        "dob_raw",
        parse_date(F.col("dob_raw"), *contracts.BIRTH_DATE_FORMATS).alias("born"),
        "enroll_dt_raw",
        parse_date(F.col("enroll_dt_raw"), contracts.FEED_DATE_FORMAT).alias(
            "enrolled"
        ),
    )


@query
def flatten_feed(spark, sf_dir):
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    return redemptions.flatten_feeds(dated).drop("ingestion_time")


@query
def flatten_json(spark, sf_dir):
    """Struct fields out of a JSON text column."""
    props = F.from_json("props", "k BIGINT")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", props.getField("k").alias("k")
    )


# --- rules and quarantine ---------------------------------------------------------


@query
def rules_structure(spark, sf_dir):
    split = split_record(derived.member_lines(spark, sf_dir))
    return with_errors(split, line_rules()).select(
        "source_path", "raw_record", _joined()
    )


@query
def rules_member(spark, sf_dir):
    decoded = members.decode_members(derived.member_lines(spark, sf_dir))
    return with_errors(decoded, member_rules(AS_OF)).select(
        "source_path", "raw_record", _joined()
    )


@query
def rules_feed(spark, sf_dir):
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    return with_errors(dated, feed_rules(AS_OF)).select(
        "source_path", "member_id", "feed_date_raw", "feed_date", _joined()
    )


@query
def rules_row(spark, sf_dir):
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    flat = redemptions.flatten_feeds(dated)
    return with_errors(flat, transaction_rules(AS_OF)).select(
        "source_path", redemptions.POSITION, "txn_id", _joined()
    )


@query
def routed_counts(spark, sf_dir):
    """How many lines, rows, feeds and transactions go which way."""
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    checked = (
        members.check_all(derived.member_lines(spark, sf_dir), AS_OF),
        redemptions.check_all(dated, AS_OF),
    )
    # Rows decoded from lines are called members.
    level = F.when(F.col(LEVEL) == members.ROW, "member").otherwise(F.col(LEVEL))
    way = F.when(is_rejected(), "invalid").otherwise("valid")
    counts = [
        records.groupBy(level.alias("level"), way.alias("way")).agg(
            F.count(F.lit(1)).alias("row_count")
        )
        for records in checked
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def quarantine_union(spark, sf_dir):
    """Bad lines and bad rows, written to the quarantine layer and read back."""
    layer = Layer(scratch_path(spark, "quarantine"), contracts.MEMBER_QUARANTINE)
    lines = derived.member_lines(spark, sf_dir)
    rejected = members.rejected_members(lines, AS_OF)
    layer.append(
        rejected.withColumn("validation_time", F.lit(SECOND_RUN)), "first"
    )
    return layer.read(spark).select(
        "source_path", "raw_record", "record_type", "field_count", "mem_id",
        "enroll_dt_raw", "enroll_dt", "dob", _joined(),
        F.col("validation_time").isNotNull().alias("is_timed"),
    )


@query
def quarantine_evolution(spark, sf_dir):
    """Two batches of different columns: bad lines as they are, then bad rows with
    columns the layer does not know yet."""
    layer = Layer(
        scratch_path(spark, "evolving"), contracts.MEMBER_RAW, evolving=True
    )
    checked = members.check_all(derived.member_lines(spark, sf_dir), AS_OF)
    bad = checked.filter(is_rejected())
    lines = bad.filter(F.col(LEVEL) == members.LINE)
    layer.append(lines.select(*contracts.column_names(contracts.MEMBER_RAW), ERRORS), "1")
    rows = bad.filter(F.col(LEVEL) == members.ROW)
    layer.append(
        rows.select("source_path", "mem_id", "dob", ERRORS, F.lit(2).alias("rule_version")),
        "2",
    )
    return layer.read(spark).select(
        "source_path", "raw_record", "mem_id", "dob", "rule_version", "batch_id", _joined()
    )


@query
def quarantine_redemptions(spark, sf_dir):
    """Bad feeds and bad transactions under one schema."""
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    rejected = redemptions.rejected_redemptions(dated, AS_OF)
    return rejected.select(
        "source_path", "member_id", "feed_date_raw", "feed_date", "txn_id",
        "miles_redeemed", "status", "_corrupt_record", _joined(),
        F.size("redemptions").alias("held_transactions"),
    )


# --- reports ----------------------------------------------------------------------


def _summary(rejected):
    return error_summary(rejected).select(_joined(), "invalid_row_count")


@query
def error_summary_members(spark, sf_dir):
    lines = derived.member_lines(spark, sf_dir)
    return _summary(members.rejected_members(lines, AS_OF))


@query
def error_summary_redemptions(spark, sf_dir):
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, sf_dir))
    return _summary(redemptions.rejected_redemptions(dated, AS_OF))


@query
def duplicate_keys_1(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query
def duplicate_keys_2(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return duplicate_keys(items, ["l_orderkey", "l_linenumber"])


@query
def emptiness_counts(spark, sf_dir):
    """Row counts and emptiness per order status, in one pass."""
    orders = table(spark, sf_dir, "orders")
    return orders.agg(
        F.count(F.lit(1)).alias("order_count"),
        F.count_if(F.col("o_orderstatus") == "P").alias("open_count"),
        (F.count_if(F.col("o_orderstatus") == "none") == 0).alias("is_empty"),
    )


@query
def sorted_limit(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_day"))
        .orderBy(F.desc("order_day"), F.asc("o_orderkey"))
        .limit(20)
    )


# --- derived attributes -----------------------------------------------------------


@query
def age_at_ingestion(spark, sf_dir):
    decoded = members.decode_members(derived.member_lines(spark, sf_dir))
    return decoded.select(
        "mem_id", "dob", age_years(F.col("dob"), AS_OF).alias("age")
    )


@query
def stale_flag(spark, sf_dir):
    decoded = members.decode_members(derived.member_lines(spark, sf_dir))
    return decoded.select(
        "mem_id",
        "flight_dt",
        is_stale(F.col("flight_dt"), AS_OF).alias("stale_member"),
    )


@query
def staged_members(spark, sf_dir):
    return _valid_members(spark, sf_dir).drop("ingestion_time")


# --- segments and exports ---------------------------------------------------------


def _latest_members(spark, sf_dir):
    return members.latest_members(_valid_members(spark, sf_dir))


@query
def country_fanout(spark, sf_dir):
    """All country tables written in one job and read back."""
    root = scratch_path(spark, "segments")
    segments.write_country_tables(_latest_members(spark, sf_dir), root)
    return read_table(
        spark, root, f"{contracts.COUNTRY_TABLE}, segment STRING"
    )


def _exported(spark, sf_dir, segment):
    """Write the segment's file as CSV and read it back as text columns."""
    rows = _latest_members(spark, sf_dir).filter(
        F.col("country_code") == segment.value
    )
    path = f"{scratch_path(spark, 'exports')}/{segment.table}.csv"
    write_csv(export_view(rows, segment), path)
    columns = ", ".join(f"`{column.title}` STRING" for column in segment.export)
    return spark.read.schema(columns).option("header", True).csv(path)


@query
def export_usa(spark, sf_dir):
    return _exported(spark, sf_dir, segments.SEGMENTS[0])


@query
def export_india(spark, sf_dir):
    return _exported(spark, sf_dir, segments.SEGMENTS[1])


@query
def export_australia(spark, sf_dir):
    return _exported(spark, sf_dir, segments.SEGMENTS[2])


@query
def export_dispatch(spark, sf_dir):
    """The files of all countries, and the countries that have none agreed."""
    root = scratch_path(spark, "dispatch")
    write_partitioned(_latest_members(spark, sf_dir), f"{root}/members", "country_code")
    held = read_table(spark, f"{root}/members", contracts.MEMBER_TARGET)
    skipped = segments.write_country_files(held, f"{root}/files")
    counts = []
    for segment in segments.SEGMENTS:
        way, rows = "skipped", spark.range(1).select(F.lit(0).cast("bigint").alias("n"))
        if segment.name not in skipped:
            path = f"{root}/files/{segment.table}.csv"
            written = spark.read.option("header", True).csv(path)
            way, rows = "written", written.agg(F.count(F.lit(1)).alias("n"))
        counts.append(
            rows.select(
                F.lit(segment.name).alias("country"),
                F.lit(way).alias("outcome"),
                F.col("n").alias("row_count"),
            )
        )
    return reduce(DataFrame.unionByName, counts)


# --- storage ----------------------------------------------------------------------


@query
def partitioned_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "roundtrip")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", "c_nationkey"
    )
    write_partitioned(customers, path, "c_nationkey")
    return read_table(
        spark,
        path,
        "c_custkey BIGINT, c_name STRING, c_mktsegment STRING, c_nationkey INT",
    )


# --- whole runs -------------------------------------------------------------------


def _in_two_runs(df, day):
    """Odd years arrive in a second run, so its dates lie between the first's."""
    odd = F.coalesce(F.year(day) % 2 == 1, F.lit(True))
    later = df.filter(odd).withColumn("ingestion_time", F.lit(SECOND_RUN))
    return df.filter(~odd), later


@query
def member_ingest(spark, sf_dir):
    """Two runs through raw, quarantine, staging, member and country tables."""
    layout = Layout(scratch_path(spark, "member-ingest"))
    lines = derived.member_lines(spark, sf_dir)
    for number, part in enumerate(_in_two_runs(lines, F.col("source_file_date"))):
        apply_member_lines(part, layout, AS_OF, SECOND_RUN, f"run-{number}")
    return layout.member_target.read(spark).drop("ingestion_time")


@query
def redemption_ingest(spark, sf_dir):
    """Two runs through quarantine and transaction tables."""
    layout = Layout(scratch_path(spark, "redemption-ingest"))
    feeds = derived.redemption_feeds(spark, sf_dir)
    day = parse_date(F.col("feed_date"), contracts.FEED_DATE_FORMAT)
    for number, part in enumerate(_in_two_runs(feeds, day)):
        apply_redemption_feeds(part, layout, AS_OF, SECOND_RUN, f"run-{number}")
    return layout.redemption_target.read(spark).drop("ingestion_time")


@query
def stream_available_now(spark, sf_dir):
    """Member lines as text files, streamed into the raw layer and decoded."""
    root = scratch_path(spark, "stream")
    lines = derived.member_lines(spark, sf_dir)
    lines.select("raw_record").write.text(f"{root}/incoming")
    raw = Layer(f"{root}/raw", contracts.MEMBER_RAW)
    stream = stream_lines(spark, f"{root}/incoming", SECOND_RUN)
    run_available(
        stream,
        f"{root}/checkpoint",
        lambda batch, number: raw.append(batch, f"stream-{number:09d}"),
    ).awaitTermination()
    decoded = members.decode_members(raw.read(spark))
    return decoded.drop(
        "source_path", "source_file_date", "ingestion_time", "raw_record"
    )


# --- runs over files --------------------------------------------------------------


def _outcome(target, ledger, quarantine):
    """Target rows, recorded files and error counts of a run as one table."""
    nothing = F.lit(None).cast("string").alias("detail")
    one = F.lit(1).cast("bigint").alias("row_count")
    files = ledger.select(
        F.lit("ledger").alias("part"), base_name("source_path").alias("item"), nothing, one
    )
    errors = error_summary(quarantine).select(
        F.lit("errors").alias("part"),
        F.concat_ws(",", ERRORS).alias("item"),
        nothing,
        F.col("invalid_row_count").alias("row_count"),
    )
    return target.withColumn("row_count", one).unionByName(files).unionByName(errors)


def _detail(*columns):
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws("|", *texts, base_name("source_path")).alias("detail")


@query
def ingest_member_files(spark, sf_dir):
    """Files with odd names, then more of them and an empty one, then none."""
    root = scratch_path(spark, "member-files")
    layout, incoming = Layout(f"{root}/tables"), f"{root}/in coming"
    deliver(member_files(spark, sf_dir), f"{root}/sent")
    for second, now in ((False, FIRST_RUN), (True, SECOND_RUN)):
        empty = EMPTY_LINES if second else None
        arrive(spark, f"{root}/sent", incoming, second, empty)
        ingest_members(spark, incoming, layout, AS_OF, now)
    ingest_members(spark, incoming, layout, AS_OF, SECOND_RUN)
    target = layout.member_target.read(spark).select(
        F.lit("target").alias("part"),
        F.col("mem_id").alias("item"),
        _detail("name", "tier", "country_code", "enroll_dt", "flight_dt", "age"),
    )
    return _outcome(
        target, layout.member_ledger.read(spark), layout.member_quarantine.read(spark)
    )


@query
def ingest_redemption_files(spark, sf_dir):
    """JSON files of many feeds, some cut off, in two runs and one without news."""
    root = scratch_path(spark, "redemption-files")
    layout, incoming = Layout(f"{root}/tables"), f"{root}/in coming"
    deliver(feed_files(spark, sf_dir), f"{root}/sent", whole=True)
    for second, now in ((False, FIRST_RUN), (True, SECOND_RUN)):
        empty = EMPTY_FEED if second else None
        arrive(spark, f"{root}/sent", incoming, second, empty)
        ingest_redemptions(spark, incoming, layout, AS_OF, now)
    ingest_redemptions(spark, incoming, layout, AS_OF, SECOND_RUN)
    target = layout.redemption_target.read(spark).select(
        F.lit("target").alias("part"),
        F.concat_ws("/", "member_id", "txn_id").alias("item"),
        _detail("feed_date", "txn_date", "partner", "miles_redeemed", "status"),
    )
    return _outcome(
        target,
        layout.redemption_ledger.read(spark),
        layout.redemption_quarantine.read(spark),
    )


@query
def stream_redemptions_merge(spark, sf_dir):
    """The same files as a stream that merges a few of them in each batch."""
    root = scratch_path(spark, "redemption-stream")
    layout, incoming = Layout(f"{root}/tables"), f"{root}/in coming"
    deliver(feed_files(spark, sf_dir), f"{root}/sent", whole=True)
    # A few batches, whatever the number of files.
    several = max(1, len(file_names(spark, f"{root}/sent")) // 5)
    for second in (False, True):
        arrive(spark, f"{root}/sent", incoming, second)
        stream_redemptions(
            spark, incoming, layout, f"{root}/checkpoint", AS_OF, SECOND_RUN,
            max_files=several,
        ).awaitTermination()
    return layout.redemption_target.read(spark).drop("ingestion_time", "source_path")


# --- the gate and the catalog -----------------------------------------------------


@query
def uniqueness_gate(spark, sf_dir):
    """What the merge accepts, and the rows of the table after each attempt."""
    columns = "c_custkey BIGINT, c_name STRING, day INT, c_nationkey INT"
    target = Target(
        name="customers",
        path=scratch_path(spark, "gate"),
        columns=columns,
        keys=("c_custkey",),
        recency=lambda column: [column("day")],
        partition_by="c_nationkey",
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.lit(1).alias("day"), F.col("c_nationkey").cast("int")
    )
    even = customers.filter("c_custkey % 2 = 0")
    newer = even.withColumn("day", F.lit(2))
    unknown = customers.orderBy("c_custkey").limit(1).withColumn(
        "c_custkey", F.lit(None).cast("bigint")
    )

    def held_twice():
        """What another writer may leave."""
        target.read(spark).write.mode("append").partitionBy("c_nationkey").parquet(
            target.data_path
        )

    odd = customers.filter("c_custkey % 2 = 1")
    attempts = [
        ("clean batch", even, None),
        ("repeated key in batch", even.unionAll(newer), None),
        ("two NULL keys in batch", unknown.unionAll(unknown), None),
        ("one NULL key in batch", unknown, None),
        ("key held twice", newer, held_twice),
        ("other key held twice", odd, None),
    ]
    seen = []
    for attempt, batch, before in attempts:
        if before:
            before()
        try:
            # A key of the batch that is held twice is found without the check of
            # the whole table; only other keys need it.
            target.apply(batch, check_whole=attempt.startswith("other"))
            outcome = "accepted"
        except ValueError:
            outcome = "refused"
        rows = target.read(spark).count()
        seen.append((attempt, outcome, rows))
    return spark.createDataFrame(seen, "attempt STRING, outcome STRING, table_rows BIGINT")


@contextmanager
def _own_catalog(spark):
    """A database for one query."""
    name, before = f"feedworks_{uuid.uuid4().hex}", spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE {name}")
    spark.catalog.setCurrentDatabase(name)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")


@query
def profile_view(spark, sf_dir):
    """Runs, DDL over their tables, the profile view, read back by SQL."""
    layout = Layout(scratch_path(spark, "catalog"))
    lines = derived.member_lines(spark, sf_dir)
    feeds = derived.redemption_feeds(spark, sf_dir)
    with _own_catalog(spark):
        create_tables(spark, layout)
        apply_member_lines(lines, layout, AS_OF, SECOND_RUN, "only")
        apply_redemption_feeds(feeds, layout, AS_OF, SECOND_RUN, "only")
        create_tables(spark, layout)
        create_profile_view(spark)
        path = scratch_path(spark, "profile")
        # Partitions of catalog tables are looked up when a query runs.
        spark.sql(f"SELECT * FROM {VIEW}").write.parquet(path)
    return spark.read.parquet(path)


@query
def country_tables(spark, sf_dir):
    """Country tables that the member run registers, read back by SQL."""
    layout = Layout(scratch_path(spark, "country-tables"))
    lines = derived.member_lines(spark, sf_dir)
    with _own_catalog(spark):
        for number, part in enumerate(_in_two_runs(lines, F.col("source_file_date"))):
            apply_member_lines(
                part, layout, AS_OF, SECOND_RUN, f"run-{number}", register=True
            )
        parts = [
            f"SELECT *, '{s.name}' AS country_table FROM {s.table}"
            for s in segments.SEGMENTS
        ]
        return spark.sql(" UNION ALL ".join(parts))
