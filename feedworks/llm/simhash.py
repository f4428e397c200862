"""SimHash fingerprints and search by permuted block tables.

Every pair of neighbouring words is a term. Its hash votes on 64 signed bits
with the term's weight; bits with more votes for than against are set. DataFrame
operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedworks.functions.once import computed_once
from feedworks.llm.shared import SPACES, stored, table, whole_text

BITS = 64
RADIUS = 3
BLOCKS = (13, 13, 13, 13, 12)
MOST_WEIGHT = 24
BUCKETS_PER_TASK = 4
MOST_BUCKETS = 4096
# Bit k and bit k + 32 of a hash, so that one sum counts votes for two bits.
_PAIR = (1 << 32) | 1


def fingerprint_terms(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """``key`` columns and ``fp``, one row for each key: the fingerprint of
    ``text``; 0 without words. Keys must be unique."""
    words = F.filter(F.split(F.col(text), f"[{SPACES}]+"), lambda w: w != "")
    paired = rows.select(*key, computed_once(words).alias("__words")).select(
        *key,
        F.explode_outer(
            F.arrays_zip(F.col("__words"), F.expr("slice(__words, 2, size(__words))").alias("n"))
        ).alias("t"),
    )
    first, second = F.col("t")["__words"], F.col("t")["n"]
    weight = F.when(
        first.isNotNull(),
        F.least(
            F.length(first) + F.coalesce(F.length(second), F.lit(0)), F.lit(MOST_WEIGHT)
        ).cast("long"),
    ).otherwise(0)
    terms = paired.select(
        *key, F.xxhash64(first, second).alias("__hash"), weight.alias("__weight")
    )
    votes = [
        F.sum(
            F.shiftrightunsigned("__hash", k).bitwiseAND(F.lit(_PAIR)) * F.col("__weight")
        ).alias(f"__votes{k}")
        for k in range(32)
    ]
    counted = terms.groupBy(*key).agg(F.sum("__weight").alias("__total"), *votes)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"__votes{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"__votes{k}", 32)
        for bit, ones in ((k, low), (k + 32, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(2 * ones > F.col("__total"), F.lit(value)).otherwise(F.lit(0)))
    return counted.select(*key, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the bits two fingerprints have in common."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def with_next(docs: DataFrame, value: Column) -> DataFrame:
    """Add ``next``: ``value`` of the next row by doc_id (NULL first) and ``h``,
    after the last row that of the first.

    Rows are dealt by doc_id into ranges. The first rows of a range also go to
    the range before, so every row meets its successor in one shuffle and no
    task orders the whole table. The driver sees only the ranges' limits.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(BUCKETS_PER_TASK * tasks, MOST_BUCKETS)
    shares = [i / ranges for i in range(1, ranges)]
    cuts, low, missing = docs.agg(
        F.percentile_approx("doc_id", shares, 100 * ranges),
        F.min("doc_id"),
        F.max(F.col("doc_id").isNull()),
    ).first()
    cuts = sorted({c for c in cuts or [] if c > low})
    last = len(cuts)
    limits = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(
        F.size(F.filter(limits, lambda c: c <= F.col("doc_id")))
    )
    first = F.col("doc_id").isNull() if missing else F.col("doc_id") == low
    goes = F.concat(
        F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("guest"))),
        # The first rows of a later range end the range before it,
        F.when(
            F.array_contains(limits, F.col("doc_id")),
            F.array(F.struct((F.col("own") - 1).alias("range"), F.lit(1).alias("guest"))),
        ).otherwise(F.array().cast("array<struct<range:int,guest:int>>")),
        # and the first rows of all end the last.
        F.when(
            first, F.array(F.struct(F.lit(last).alias("range"), F.lit(2).alias("guest")))
        ).otherwise(F.array().cast("array<struct<range:int,guest:int>>")),
    )
    dealt = docs.withColumn("own", own).withColumn("to", F.explode(goes))
    order = Window.partitionBy("to.range").orderBy(
        "to.guest", F.asc_nulls_first("doc_id"), "h"
    )
    return (
        dealt.withColumn("next", F.lead(value).over(order))
        .filter("to.guest = 0")
        .drop("to", "own")
    )


def _blocks(fp: Column) -> list[Column]:
    parts, shift = [], 0
    for width in BLOCKS:
        parts.append(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        shift += width
    return parts


def block_tables(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` once for each permuted table: ``table`` and ``key``, the bits of
    as many blocks as ``radius`` differing bits must leave untouched."""
    parts = _blocks(F.col("fp"))
    chosen: Sequence[tuple[int, ...]] = list(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))
    if radius >= len(BLOCKS):
        raise ValueError(f"the radius must be below {len(BLOCKS)}")
    keys = []
    for number, blocks in enumerate(chosen):
        key = F.lit(0).cast("long")
        for i in blocks:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(parts[i])
        keys.append(F.struct(F.lit(number).alias("table"), key.alias("key")))
    return rows.withColumn("at", F.explode(F.array(*keys))).select("*", "at.table", "at.key").drop("at")


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``query`` and ``fp``: for each distinct query fingerprint, all distinct
    ``fingerprints`` that differ in at most ``radius`` bits, itself included."""
    asked = block_tables(queries.select("fp").distinct(), radius)
    index = block_tables(fingerprints.select("fp").distinct(), radius)
    return (
        asked.withColumnRenamed("fp", "query")
        .join(index, ["table", "key"])
        .filter(F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius)
        .select("query", "fp")
        .distinct()
    )


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, their likeness to
    each other and to the next document, and, for ids divisible by 100,
    ``n_within``: how many other documents lie within RADIUS bits.

    NULL texts are empty; texts without words have fingerprint 0; rows with
    equal ids follow each other by text; a single row is its own next.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("h"))
    text, n = whole_text(), F.length(whole_text())
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(text, F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)
    )
    numbered = with_next(docs, whole_text()).withColumn("row", F.monotonically_increasing_id())
    versions = numbered.select(
        "doc_id",
        "h",
        n.cast("long").alias("n_chars"),
        "row",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("turn"), text.alias("text")),
                F.struct(F.lit(1).alias("turn"), edited.alias("text")),
            )
        ).alias("version"),
    )
    named = versions.select(
        "doc_id", "h", "n_chars", "row", "version.turn", "version.text",
        F.when(F.col("version.turn") == 1, F.sha2("version.text", 256)).alias("sha"),
    )
    row = ["row", "doc_id", "h", "n_chars"]
    prints = stored(
        fingerprint_terms(named, "text", *row, "turn", "sha")
        .groupBy(*row)
        .agg(
            F.max(F.when(F.col("turn") == 0, F.col("fp"))).alias("fp"),
            F.max(F.when(F.col("turn") == 1, F.col("fp"))).alias("edited"),
            F.max("sha").alias("edited_sha256"),
        ),
        "simhash-prints",
    )
    counts = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("copies")), "simhash-counts")
    asked = prints.filter(F.col("doc_id") % 100 == 0)
    near = (
        within(asked, counts)
        .join(counts, "fp")
        .groupBy("query")
        .agg((F.sum("copies") - 1).alias("n_near"))
    )
    paired = with_next(prints, F.col("fp"))
    answered = paired.join(near, F.col("fp") == F.col("query"), "left")
    hexed = {c: F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("fp", "edited")}
    return answered.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed["fp"].alias("fingerprint"),
        hexed["edited"].alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_within"),
    )
