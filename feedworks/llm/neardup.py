"""Near-duplicate documents by SimHash and tiled exact comparison.

Distinct fingerprints are sorted by the population counts of their quarters and
cut into stripes. Two stripes meet in one task, which compares tiles by numpy
exclusive-or and bit counts. Two fingerprints differ in at least as many bits
as their population counts do, quarter by quarter, so tiles, and whole stripes,
further apart than the radius are skipped. Nothing else is: the comparison is
exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedworks.llm.components import connected_components
from feedworks.llm.shared import as_bytes, slices, stored, table

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
LEAST_STRIPE, MOST_STRIPE, STRIPES = 1 << 13, 1 << 20, 64
PACKED = 4096
TILE = 256
PAIRS_HELD = 1 << 20


def fingerprint(data: bytes) -> int:
    """Bits set in over half the hashes of a text's shingles; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)
    shingles = map(b" ".join, runs) if len(words) >= SHINGLE_WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text) and ``fp`` for every row."""
    picked = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = picked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            values = [fingerprint(data) for data in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.int64())],
                names=["doc_id", "h", "fp"],
            )

    return picked.mapInArrow(run, f"doc_id {kind}, h BIGINT, fp BIGINT")


def _quarters(fp: Column) -> list[Column]:
    return [
        F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))
        for i in range(4)
    ]


def _counts(values: np.ndarray) -> np.ndarray:
    """Population count of each 16-bit quarter."""
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``size`` nodes reaches over links a-b."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(root[a], root[b]):
            return root


def _tiles(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by quarter counts, tile starts, and each tile's range of counts."""
    counts = _counts(values)
    order = np.lexsort(counts.T[::-1])
    counts = counts[order]
    starts = np.arange(0, len(values), TILE)
    return (
        order,
        starts,
        np.minimum.reduceat(counts, starts, axis=0),
        np.maximum.reduceat(counts, starts, axis=0),
    )


def links_within(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between (or, without ``right``, within)
    sets of fingerprints: pairs of fingerprints. Pairs of a tile are merged as
    they are found, so memory does not follow the number of links."""
    both = left if right is None else np.concatenate([left, right])
    if len(left) == 0 or len(both) == 0 or (right is not None and len(right) == 0):
        return both[:0], both[:0]
    order_a, starts_a, low_a, high_a = _tiles(left)
    if right is None:
        order_b, starts_b, low_b, high_b = order_a, starts_a, low_a, high_a
        shift = 0
    else:
        order_b, starts_b, low_b, high_b = _tiles(right)
        shift = len(left)
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0

    def merged() -> None:
        nonlocal found_a, found_b, held
        if found_a:
            root = forest(len(both), np.concatenate(found_a), np.concatenate(found_b))
            nodes = np.flatnonzero(root != np.arange(len(both)))
            found_a, found_b, held = [nodes], [root[nodes]], 0

    sorted_b = both[shift:][order_b] if right is not None else left[order_b]
    for i, start in enumerate(starts_a):
        rows = order_a[start : start + TILE]
        apart = np.maximum(np.maximum(low_b - high_a[i], low_a[i] - high_b), 0).sum(1)
        near = np.flatnonzero(apart <= radius)
        if right is None:
            near = near[near >= i]
        for tiles in np.array_split(near, max(1, -(-len(near) // 32))) if len(near) else []:
            columns = (starts_b[tiles][:, None] + np.arange(TILE)).ravel()
            columns = columns[columns < len(sorted_b)]
            differing = np.bitwise_count(left[rows][:, None] ^ sorted_b[columns])
            x, y = np.nonzero(differing <= radius)
            a, b = rows[x], order_b[columns[y]] + shift
            apart_rows = a != b
            if apart_rows.any():
                found_a.append(a[apart_rows])
                found_b.append(b[apart_rows])
                held += len(found_a[-1])
            if held > PAIRS_HELD:
                merged()
    merged()
    if not found_a:
        return both[:0], both[:0]
    return both[found_a[0]], both[found_b[0]]


def _stripe_pairs(boxes: list, radius: int) -> list[tuple[int, int, int]]:
    """Which stripes must meet: (stripe, pair, side), from the stripes' ranges
    of counts, one row per stripe."""
    meets, pair = [], 0
    for i, a in enumerate(boxes):
        for b in boxes[i:]:
            apart = sum(
                max(a[f"low{q}"] - b[f"high{q}"], b[f"low{q}"] - a[f"high{q}"], 0) for q in range(4)
            )
            if apart <= radius:
                meets.append((a["stripe"], pair, 0))
                if a["stripe"] != b["stripe"]:
                    meets.append((b["stripe"], pair, 1))
                pair += 1
    return meets


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u``, ``v``: links whose components are those of all pairs of the
    distinct fingerprints ``fp`` that differ in at most ``radius`` bits.

    ``distinct`` should be stored: it is read three times. The driver sees one
    row for each stripe, and a stripe holds a 64th of the fingerprints or at
    most MOST_STRIPE; every stripe goes to the tasks it must meet.
    """
    spark = distinct.sparkSession
    fp = F.col("fp")
    quarters = _quarters(fp)
    key = F.lit(0).cast("long")
    for quarter in quarters:
        key = key * 32 + quarter
    key = key * (1 << 32) + F.pmod(F.xxhash64(fp), F.lit(1 << 32))
    keyed = distinct.select("fp", key.alias("key"))
    size = distinct.count()
    stripe_rows = min(max(size // STRIPES, LEAST_STRIPE), MOST_STRIPE)
    stripes = -(-size // stripe_rows)
    cuts: list[int] = []
    if stripes > 1:
        shares = [i / stripes for i in range(1, stripes)]
        cuts = sorted(set(keyed.agg(F.percentile_approx("key", shares, 100 * stripes)).first()[0]))
    # The cuts before a key, found by halving.
    stripe = _bucket(F.col("key"), cuts)
    striped = keyed.select("fp", stripe.alias("stripe"))
    boxes = (
        striped.groupBy("stripe")
        .agg(
            *[F.min(q).alias(f"low{i}") for i, q in enumerate(quarters)],
            *[F.max(q).alias(f"high{i}") for i, q in enumerate(quarters)],
        )
        .orderBy("stripe")
        .collect()
    )
    meets = spark.createDataFrame(
        _stripe_pairs(boxes, radius), "stripe INT, pair INT, side INT"
    )
    packs = -(-stripe_rows // PACKED)
    packed = (
        striped.withColumn("pack", F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(packs)))
        .groupBy("stripe", "pack")
        .agg(F.collect_list("fp").alias("fps"))
    )

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = [
            np.concatenate([np.empty(0, np.uint64)] + [
                np.asarray(x, np.int64).view(np.uint64) for x in rows.fps[rows.side == side]
            ])
            for side in (0, 1)
        ]
        u, v = links_within(sides[0], sides[1] if len(sides[1]) else None, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    tasks = max(1, min(meets.count(), 4 * spark.sparkContext.defaultParallelism * 8))
    return (
        packed.join(meets, "stripe")
        .repartition(tasks, "pair")
        .groupBy("pair")
        .applyInPandas(compare, "u BIGINT, v BIGINT")
    )


def _bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(value < cuts[middle], _bucket(value, cuts[:middle])).otherwise(
        _bucket(value, cuts[middle + 1 :]) + (middle + 1)
    )


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``h``, ``fp``, ``component_id``, ``root`` for every row.

    ``component_id`` is the smallest doc_id among documents reachable by links;
    equal fingerprints are one node, so copies cost no pairs. Rows with a NULL
    doc_id take part and are never the smallest; a component of such rows only
    has NULL. Texts without words share fingerprint 0. ``root`` names the
    component by one of its fingerprints.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(
        prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints"
    )
    members = connected_components(stored(near_links(distinct, radius), "fingerprint-links"))
    rooted = distinct.join(
        members.withColumnRenamed("node", "fp"), "fp", "left"
    ).select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(lowest, "root")
    return prints.join(named, "fp").select("doc_id", "h", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, radius: int = RADIUS, groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest
    doc_id, NULL last, then the smallest hash of the text. ``groups`` (doc_id,
    h, root) are those of ``near_groups`` if not given."""
    groups = stored(near_groups(docs, radius) if groups is None else groups, "near-groups")
    first = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h")).alias("best")
    )
    best = first.select(F.col("best.doc_id").alias("best_id"), F.col("best.h").alias("best_h"))
    names = docs.columns
    tagged = docs.select(
        *[F.col(c).alias(f"own_{i}") for i, c in enumerate(names)],
        F.col("doc_id").alias("row_id"),
        F.xxhash64("text").alias("row_h"),
    )
    kept = tagged.join(
        best, (F.col("row_h") == F.col("best_h")) & F.col("row_id").eqNullSafe(F.col("best_id"))
    )
    # A row that repeats the one that stays, id and text alike, goes too.
    turn = F.row_number().over(Window.partitionBy("row_h", "row_id").orderBy("row_h"))
    return kept.withColumn("turn", turn).filter("turn = 1").select(
        *[F.col(f"own_{i}").alias(c) for i, c in enumerate(names)]
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
