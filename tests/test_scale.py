"""The plans that keep the work bounded when tables and hot keys are large."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from feedworks.catalogue import derived, feed_files
from feedworks.catalogue.queries import _in_two_runs, all_queries
from feedworks.operators.enrich import enrich_with_dimension
from feedworks.operators.latest import latest_per_key, newest_first
from feedworks.operators.quality import duplicate_keys
from feedworks.operators.rules import is_rejected
from feedworks.operators.upsert import changed_rows, upsert
from feedworks.plans import members, redemptions
from feedworks.plans.ingest import apply_redemption_feeds
from feedworks.plans.layout import Layout
from feedworks.sinks.exports import Segment, fan_out
from feedworks.sinks.targets import Target, gathered, write_partitioned
from feedworks.sources.files import not_processed
from feedworks.sources.storage import exists, scratch_path

SF_DIR = "/root/testdata/sf0.001"
WRITING = {
    "upsert_target", "quarantine_union", "country_fanout", "export_usa",
    "export_india", "export_australia", "partitioned_roundtrip", "member_ingest",
    "redemption_ingest", "stream_available_now", "ingest_member_files",
    "ingest_redemption_files", "stream_redemptions_merge", "uniqueness_gate",
    "profile_view", "country_tables", "quarantine_evolution",
    "export_dispatch",
}


def plan(df):
    """The physical plan; the final adaptive one if ``df`` was collected."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Set SQL settings for one test."""
    changed = {}

    def put(**values):
        for name, value in values.items():
            key = "spark.sql." + name.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, old in changed.items():
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - WRITING))
def test_queries_stay_inside_spark(spark, settings, name):
    settings(autoBroadcastJoinThreshold="-1")
    text = plan(all_queries()[name](spark, SF_DIR))
    for unwanted in ("Python", "Cartesian", "NestedLoop", "BroadcastHashJoin"):
        assert unwanted not in text


def test_latest_cuts_to_one_row_per_key_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(latest_per_key(df, ["k"], newest_first([F.col("id")])))
    final, shuffle, partial = (
        text.index(part) for part in ("Final", "Exchange hashpartitioning", "Partial")
    )
    assert final < shuffle < partial


def test_a_hot_fact_key_is_split(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        adaptive__advisoryPartitionSizeInBytes="10KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
    )
    facts = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
    )
    dimension = spark.range(0, 60000, 1, 8).select(F.col("id").alias("d"), F.lit("x").alias("n"))
    joined = enrich_with_dimension(facts, dimension, "k", "d", ["k", "v"], ["n"])
    assert len(joined.collect()) == 60000
    assert "skew=true" in plan(joined)


def test_a_hot_partition_is_written_by_several_tasks(spark, settings, root):
    settings(
        adaptive__advisoryPartitionSizeInBytes="50KB",
        adaptive__coalescePartitions__parallelismFirst="false",
    )
    df = spark.range(0, 40000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
        F.when(F.col("id") < 30000, "hot").otherwise((F.col("id") % 3).cast("string")).alias("p"),
    )
    written = write_partitioned(gathered(df, "p"), f"{root}/t", "p")
    assert sorted(written) == ["0", "1", "2", "hot"]
    files = {p: len(glob.glob(f"{root}/t/p={p}/*.parquet")) for p in written}
    assert files["hot"] > 3
    assert files["0"] <= 2


def test_null_keys_do_not_pile_up_in_the_full_join(spark):
    df = spark.createDataFrame([("1", 1), (None, 2)], "k string, v int")
    text = plan(upsert(df, df, ["k"], lambda c: [c("v")]))
    join = text[text.index("FullOuter"):]
    assert join.count("isnotnull(k") >= 2


def test_a_merge_reads_only_keys_and_recency_of_the_held_table(spark, root):
    columns = "k STRING, day INT, payload STRING, p STRING"
    target = Target("t", root, columns, ("k",), lambda c: [c("day")], "p")
    target.apply(spark.createDataFrame([("1", 1, "x", "a"), ("2", 1, "x", "b")], columns))
    batch = spark.createDataFrame([("1", 2, "y", "a")], columns)
    held = target.read(spark)
    text = plan(changed_rows(held, batch, ["k"], target.recency, ["p"]))
    assert "payload" not in re.search(r"ReadSchema: \S+", text).group(0)
    pruned = plan(held.filter(F.col("p").isin(["a"])))
    assert re.search(r"PartitionFilters: \[[^\]]*p#\d+ (=|IN)", pruned)


def test_each_field_is_parsed_once_per_row(spark):
    lines = derived.member_lines(spark, SF_DIR)
    path = scratch_path(spark, "lines")
    lines.write.parquet(path)
    text = plan(members.check_members(spark.read.parquet(path), derived.AS_OF).valid)
    assert text.count("split(") == 1
    assert text.count("gettimestamp(") == 4
    assert "Exchange" not in text


def test_counts_aggregate_before_the_shuffle(spark):
    text = plan(duplicate_keys(spark.range(10), ["id"]))
    assert "partial_count" in text


def test_the_ledger_check_does_not_shuffle_by_content(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    files = spark.createDataFrame([("a", "f1"), ("b", "f2")], "path string, source_path string")
    ledger = spark.createDataFrame([("f1",)], "source_path string")
    fresh = not_processed(files, ledger)
    assert "LeftAnti" in plan(fresh)
    assert [r.path for r in fresh.collect()] == ["b"]


def test_fan_out_is_one_write_without_shuffle(spark, root):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, "Z")], "v int, c string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    fan_out(df, root, "c", [Segment("A", "a", "t_a"), Segment("B", "b", "t_b")], ["v", "c"])
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(jobs) == 1
    stored = spark.read.parquet(root).select("v", "c", "segment")
    assert sorted(map(tuple, stored.collect())) == [(1, "A", "a"), (2, "B", "b")]


def test_a_small_batch_does_not_shuffle_the_held_table(spark, root, settings):
    # Plans cut off paths that are longer than this.
    settings(maxMetadataStringLength="1000")
    columns = "k BIGINT, day INT, payload STRING, p STRING"
    target = Target("t", f"{root}/t", columns, ("k",), lambda c: [c("day")], "p")
    held = spark.range(20000).select(
        F.col("id").alias("k"), F.lit(1).alias("day"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.lit("a").alias("p"),
    )
    target.apply(held)
    held.limit(3).withColumn("day", F.lit(2)).write.parquet(f"{root}/batch")
    batch = spark.read.parquet(f"{root}/batch")
    lines = plan(changed_rows(target.read(spark), batch, ["k"], target.recency, ["p"])).splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "/t/data" in line)
    depth = [len(re.match(r"[\s:|+*()\d-]*", line).group()) for line in lines]
    above = []
    for i in range(at, -1, -1):
        if depth[i] < depth[at]:
            depth[at] = depth[i]
            above.append(lines[i])
    joined = next(i for i, line in enumerate(above) if "Join" in line)
    assert "BroadcastHashJoin" in above[joined] and "Inner" in above[joined]
    assert not any("Exchange hash" in line for line in above[:joined])


def test_a_large_batch_meets_the_held_table_in_a_sort_merge(spark, root, settings):
    settings(autoBroadcastJoinThreshold="-1")
    columns = "k BIGINT, day INT, p STRING"
    data = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("day"), F.lit("a").alias("p"))
    text = plan(changed_rows(data, data, ["k"], lambda c: [c("day")], ["p"]))
    assert columns and "Broadcast" not in text and "Cartesian" not in text


def test_lines_and_rows_are_checked_in_one_pass(spark, root):
    derived.member_lines(spark, SF_DIR).write.parquet(f"{root}/lines")
    lines = spark.read.parquet(f"{root}/lines")
    checked = members.check_all(lines, derived.AS_OF)
    for df in (checked, members.quarantined(checked)):
        text = plan(df)
        assert text.count("FileScan") == 1 and text.count("split(raw_record") == 1
        assert text.count("gettimestamp(") == 4 and "Exchange" not in text
    parted = members.check_lines(lines), members.check_members(lines, derived.AS_OF)
    for part, level in zip(parted, (members.LINE, members.ROW), strict=True):
        own = checked.filter(F.col("level") == level)
        assert own.filter(is_rejected()).count() == part.invalid.count() > 0
        assert own.filter(~is_rejected()).count() == part.valid.count() > 0


def test_feeds_and_transactions_are_checked_in_one_pass(spark, root):
    feeds = redemptions.date_feeds(derived.redemption_feeds(spark, SF_DIR))
    feeds.write.parquet(f"{root}/feeds")
    dated = spark.read.parquet(f"{root}/feeds")
    checked = redemptions.check_all(dated, derived.AS_OF)
    text = plan(redemptions.quarantined(checked))
    assert text.count("FileScan") == 1 and "Exchange" not in text
    levels = (redemptions.FEED, redemptions.TRANSACTION)
    parted = redemptions.check_feeds(dated, derived.AS_OF), redemptions.check_transactions(dated, derived.AS_OF)
    for part, level in zip(parted, levels, strict=True):
        own = checked.filter(F.col("level") == level)
        assert own.filter(is_rejected()).count() == part.invalid.count() > 0
        assert own.filter(~is_rejected()).count() == part.valid.count() > 0


def test_a_filter_on_the_feed_date_is_worked_out_before_the_join(spark):
    feeds = derived.redemption_feeds(spark, SF_DIR)
    for part in _in_two_runs(feeds, F.to_date("feed_date", "yyyyMMdd")):
        joins = [line for line in plan(part).splitlines() if "Join" in line]
        assert len(joins) == 1 and "2) = 1" not in joins[0]


def test_feeds_are_derived_in_methods_the_jvm_compiles(spark, settings):
    settings(**{"adaptive.enabled": "false"})
    dated = redemptions.date_feeds(derived.redemption_feeds(spark, SF_DIR))
    text = spark._jvm.PythonSQLUtils.explainString(dated._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_days_are_written_as_the_formatter_does(spark):
    texts = ["0999-02-28", "1000-01-01", "1996-02-29", "9999-12-31", None]
    days = spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_date("t").alias("d"))
    days = days.unionByName(spark.sql("SELECT date_add(DATE'9999-12-31', 1) AS d"))
    rows = days.select(derived._day(F.col("d")), F.date_format("d", "yyyyMMdd")).collect()
    assert len(rows) == 6 and all(day == formatted for day, formatted in rows)


def shuffle_files(spark):
    disks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {
        name
        for folder in disks.localDirsString()
        for name in glob.glob(f"{folder}/*/shuffle_*")
    }


def test_delivered_files_are_whole_and_leave_no_shuffle(spark, settings, monkeypatch, root):
    settings(autoBroadcastJoinThreshold="-1")
    monkeypatch.setattr(feed_files, "FEED_KEYS", 50)
    files = feed_files.feed_files(spark, SF_DIR)
    want = {(str(r.second).lower(), r.file_name, r.value) for r in files.collect()}
    assert len(want) > 20
    before = shuffle_files(spark)
    feed_files.deliver(files, f"{root}/sent", whole=True)
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    held = spark.read.text(f"{root}/sent", wholetext=True)
    got = [(r.second, r.file_name, r.value.removesuffix("\n")) for r in held.collect()]
    assert len(got) == len(want) and set(got) == want


def test_a_merge_begins_without_what_its_batch_came_from(spark, settings, monkeypatch, root):
    settings(autoBroadcastJoinThreshold="-1")
    layout = Layout(f"{root}/out")
    feeds = derived.redemption_feeds(spark, SF_DIR)
    apply_redemption_feeds(feeds, layout, derived.AS_OF, derived.SECOND_RUN, "first")
    held = f"{layout.redemption_held}/second"
    batch = layout.redemption_target._batch_path
    merge, replace, seen = Target._merge, Target._replace, []

    def merging(self, *given):
        seen.append(exists(spark, held))
        return merge(self, *given)

    def replacing(self, *given):
        seen.append(exists(spark, batch))
        return replace(self, *given)

    monkeypatch.setattr(Target, "_merge", merging)
    monkeypatch.setattr(Target, "_replace", replacing)
    before = shuffle_files(spark)
    later = feeds.withColumn("ingestion_time", F.lit(derived.SECOND_RUN))
    apply_redemption_feeds(later, layout, derived.AS_OF, derived.SECOND_RUN, "second")
    assert seen == [False, False]
    assert shuffle_files(spark) <= before
