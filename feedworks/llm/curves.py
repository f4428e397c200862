"""Approximate nearest neighbours by shifted space-filling curves.

Each of CURVES curves projects the vectors to AXES random directions, shifts them
and orders them by their place on a Hilbert curve. The orders are made by range
partitioning in Spark; a row's rank is its place in its range plus the rows of
the ranges before. A query meets the rows within a window of ranks around its own
on every curve, and what the windows hold is merged and ranked by distance.

Vectors near in space need not be near on a curve, and how far apart they lie
follows the data's dimensions. The window is therefore measured: for SAMPLE
vectors the true neighbours are found by comparing all rows, and the window is
the least that holds RECALL of them on at least one curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedworks.llm.shared import slices, stored, table

# Fixed values of the contract.
BEST = 10
ASKED = 100

CURVES = 12
AXES = 8
BITS = 7
SAMPLE = 64
RECALL = 0.95
LEAST_WINDOW = 512
MOST_BLOCK = 1 << 14
SEARCHES_TOGETHER = 1 << 12
DISTANCES_HELD = 1 << 22

USABLE = (
    "vec_id IS NOT NULL AND embedding IS NOT NULL AND "
    "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) "
    "AND exists(embedding, x -> x <> 0)"
)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve through all cells of a cube, whose coordinates
    have ``bits`` bits: from the highest bit down, each level's reflections and
    exchanges of axes are undone, then a Gray code is read."""
    x = cells.T.astype(np.int64)
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(axes):
            upper = (x[i] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & below)
            x[i] ^= swap
            x[0] ^= np.where(upper, below, swap)
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | (x[i] >> level & 1)
    return place


def places(vectors: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The place of every vector on every curve. Directions and shifts follow from
    the vectors' length alone; ``spread`` scales each vector's coordinates."""
    dim = vectors.shape[1]
    rnd = np.random.default_rng(dim)
    out = np.empty((CURVES, len(vectors)), np.int64)
    # Directions of one turn of the space are at right angles, so curves that
    # share it see different parts of a vector.
    directions = np.empty((dim, 0))
    while directions.shape[1] < CURVES * AXES:
        turned = np.linalg.qr(rnd.normal(size=(dim, dim)))[0]
        directions = np.concatenate([directions, turned], axis=1)
    for curve in range(CURVES):
        seen = vectors @ directions[:, curve * AXES : (curve + 1) * AXES]
        # Four deviations to either side fill half of the cube; the shift moves
        # them within it.
        unit = np.clip(seen / (16 * spread[:, None]) + 0.25, 0, 0.5) + rnd.random(seen.shape[1]) / 2
        out[curve] = hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of equally many vectors, components added in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k]) ** 2
    return np.sqrt(total)


def nearest(queries: np.ndarray, rows: np.ndarray, low: np.ndarray, able: np.ndarray | None = None):
    """For each query the BEST nearest ``able`` rows (all, if None): query and row
    numbers and distances; equal distances by the smaller ``low``. Products of
    matrices find who may be among them, differences decide."""
    out: list[tuple[np.ndarray, ...]] = []
    squares = (rows**2).sum(1)
    step = max(1, DISTANCES_HELD // max(1, len(rows)))
    for start in range(0, len(queries), step):
        some = queries[start : start + step]
        own = (some**2).sum(1)
        rough = own[:, None] + squares - 2 * some @ rows.T
        # More than what rounding can have moved.
        slack = 1e-9 * (own + squares.max(initial=0))
        if able is not None:
            rough[~able[start : start + step]] = np.inf
        k = min(BEST, len(rows)) - 1
        bar = np.partition(rough, k, axis=1)[:, k] + slack
        q, r = np.nonzero((rough <= bar[:, None]) & (rough < np.inf))
        d = distances(some[q], rows[r])
        order = np.lexsort((low[r], d, q))
        q, r, d = q[order], r[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < BEST
        out.append((q[best] + start, r[best], d[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    own = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return own.astype(float).reshape(len(rows), dim)


def vector_nodes(able: DataFrame) -> DataFrame:
    """One row for each distinct vector: ``node``, ``dim``, ``embedding``, the
    smallest ids (``ids``, BEST and one more, in order), the smallest of all
    (``low``), and ``asks``: whether a query has this vector. A window limits ids
    before the shuffle, so a vector that a third of all rows hold is no hot key."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = able.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEST + 1)
    asks = able.filter(F.col("vec_id") % ASKED == 0).select("embedding").distinct().withColumn("asks", F.lit(True))
    grouped = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return (
        grouped.join(asks, "embedding", "left")
        .select(
            "embedding", "ids", F.col("ids")[0].alias("low"), F.size("embedding").alias("dim"),
            F.coalesce("asks", F.lit(False)).alias("asks"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )


def curve_ranks(nodes: DataFrame) -> DataFrame:
    """``node``, ``curve``, ``dim``, ``rank``: ranks run on over all curves and
    vector lengths, and are neighbours only where both are equal."""
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    spread = nodes.groupBy("dim").agg(F.sqrt(F.avg(squares / F.col("dim"))).alias("spread"))
    scaled = nodes.select("node", "dim", "embedding").join(spread, "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            dims, column, node, spread = batch.columns
            dims, spread = dims.to_numpy(), spread.to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                found = places(_matrix(column, own, dim), spread[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(node.to_numpy()[own], CURVES)),
                        pa.array(np.full(CURVES * len(own), dim, np.int32)),
                        pa.array(np.repeat(np.arange(CURVES, dtype=np.int32), len(own))),
                        pa.array(found.ravel()),
                    ],
                    names=["node", "dim", "curve", "place"],
                )

    keyed = scaled.select("dim", "embedding", "node", "spread").mapInArrow(
        run, "node BIGINT, dim INT, curve INT, place BIGINT"
    )
    order = ["curve", "dim", "place", "node"]
    ranged = stored(
        keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "node", "dim", "curve", F.monotonically_increasing_id().alias("at")
        ),
        "curve-ranges",
    )
    # A number's high bits are its range, the others its place in it.
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, starts = 0, {}
    for row in sizes:
        starts[row.part] = before - (row.part << 33)
        before += row["count"]
    if not starts:
        return ranged.select("node", "dim", "curve", F.col("at").alias("rank"))
    offsets = nodes.sparkSession.createDataFrame(list(starts.items()), "part BIGINT, offset BIGINT")
    return ranged.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "node", "dim", "curve", (F.col("at") + F.col("offset")).alias("rank")
    )


def true_neighbours(nodes: DataFrame) -> DataFrame:
    """``asked``, ``node``: the BEST nearest of SAMPLE vectors, those with the
    smallest hashes, found by comparing them with every row."""
    sample = nodes.orderBy(F.xxhash64("embedding"), "node").limit(SAMPLE).select("node", "dim", "embedding").collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row.dim, []).append(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            dims, column, node = batch.columns
            dims, node = dims.to_numpy(), node.to_numpy()
            for dim, rows in by_dim.items():
                own = np.flatnonzero(dims == dim)
                if len(own):
                    asked = np.array([r.node for r in rows])
                    able = asked[:, None] != node[own]
                    vectors = _matrix(column, own, dim)
                    q, r, d = nearest(np.array([r.embedding for r in rows], float), vectors, node[own], able)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked[q]), pa.array(node[own][r]), pa.array(d)], names=["asked", "node", "d"]
                    )

    found = nodes.select("dim", "embedding", "node").mapInArrow(run, "asked BIGINT, node BIGINT, d DOUBLE")
    order = Window.partitionBy("asked").orderBy("d", "node")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEST).select("asked", "node")


def measured_window(nodes: DataFrame, ranks: DataFrame) -> int:
    """The least window that holds RECALL of the sample's true neighbours."""
    pairs = stored(true_neighbours(nodes), "curve-sample")
    asked = pairs.select("asked").distinct().join(ranks, F.col("asked") == F.col("node")).select(
        "asked", "curve", F.col("rank").alias("own")
    )
    gaps = (
        pairs.join(ranks, "node").join(asked, ["asked", "curve"])
        .groupBy("asked", "node").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    )
    least = gaps.agg(F.percentile("gap", F.lit(RECALL))).first()[0]
    return max(LEAST_WINDOW, int(np.ceil(least or 0)))


def search_block(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """The nearest rows of one block of ranks for each query that meets it."""
    out: dict[str, list] = {"asked": [], "node": [], "low": [], "score": []}
    for _, own in rows.groupby(["curve", "dim"], sort=False):
        held, asking = own[~own.search], own[own.search]
        if not len(held) or not len(asking):
            continue
        vectors = np.array(held.embedding.tolist(), float)
        queries = np.array(asking.embedding.tolist(), float)
        node, low, asked = held.node.to_numpy(), held.low.to_numpy(), asking.node.to_numpy()
        gap = np.abs(asking["rank"].to_numpy()[:, None] - held["rank"].to_numpy())
        q, r, d = nearest(queries, vectors, low, (gap <= window) & (asked[:, None] != node))
        for name, found in (("asked", asked[q]), ("node", node[r]), ("low", low[r]), ("score", d)):
            out[name].append(found)
    if not out["asked"]:
        return pd.DataFrame({"asked": [], "node": [], "low": [], "score": []}).astype(
            {"asked": "int64", "node": "int64", "low": "int64"}
        )
    return pd.DataFrame({name: np.concatenate(found) for name, found in out.items()})


def near_nodes(nodes: DataFrame, ranks: DataFrame, window: int) -> DataFrame:
    """``asked``, ``node``, ``score``: the BEST nearest vectors of every vector
    that is asked for, among those in its windows.

    Ranks are cut into blocks. A query goes to the few blocks its window touches,
    and a block to as many groups as its queries fill, so no group grows with the
    table.
    """
    block = min(max(window, LEAST_WINDOW), MOST_BLOCK)
    asking = ranks.join(nodes.filter("asks").select("node"), "node", "left_semi")
    touched = F.sequence(
        F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block), F.floor((F.col("rank") + window) / block)
    )
    touches = stored(
        asking.withColumn("block", F.explode(touched)).select("node", "dim", "curve", "rank", "block"), "curve-touches"
    )
    turns = touches.groupBy("block").agg(
        F.ceil(F.count(F.lit(1)) / SEARCHES_TOGETHER).cast("int").alias("turns")
    )
    searches = touches.join(turns, "block").select(
        "node", "dim", "curve", "rank", "block", F.pmod(F.xxhash64("node"), F.col("turns")).alias("turn"),
        F.lit(True).alias("search"),
    )
    held = ranks.withColumn("block", F.floor(F.col("rank") / block)).join(turns, "block").select(
        "node", "dim", "curve", "rank", "block", F.explode(F.expr("sequence(0L, turns - 1L)")).alias("turn"),
        F.lit(False).alias("search"),
    )
    met = held.unionByName(searches).join(nodes.select("node", "low", "embedding"), "node")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return search_block(rows, window)

    parallel = nodes.sparkSession.sparkContext.defaultParallelism
    found = met.repartition(32 * parallel, "block", "turn").groupBy("block", "turn").applyInPandas(
        run, "asked BIGINT, node BIGINT, low BIGINT, score DOUBLE"
    )
    once = found.groupBy("asked", "node").agg(F.min("low").alias("low"), F.min("score").alias("score"))
    order = Window.partitionBy("asked").orderBy("score", "low")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEST).select(
        "asked", "node", "score"
    )


def _first(entries: Column) -> Column:
    return F.slice(F.sort_array(entries), 1, BEST + 1)


def nearest_vectors(vectors: DataFrame, window: int | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the BEST nearest rows found
    for every row whose vec_id is divisible by ASKED, nearest first, equal
    distances by the smaller vec_id.

    Rows without id or vector, zero vectors and vectors with NULL or non-finite
    components take no part; only vectors of one length are compared. Rows are
    rows of their own where ids or vectors repeat: equal vectors are found once
    and give all their ids. ``window`` may be given instead of measured.
    """
    able = vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.coalesce(F.expr(USABLE), F.lit(False)))
    nodes = stored(vector_nodes(able), "curve-nodes")
    ranks = stored(curve_ranks(nodes), "curve-ranks")
    near = near_nodes(nodes, ranks, window or measured_window(nodes, ranks))
    own = nodes.filter("asks").select(F.col("node").alias("asked"), "node", F.lit(0.0).alias("score"))
    entries = (
        near.unionByName(own).join(nodes.select("node", "ids"), "node")
        .select("asked", F.explode(F.transform("ids", lambda i: F.struct(F.col("score"), i.alias("vec_id")))).alias("e"))
        .groupBy("asked").agg(_first(F.collect_list("e")).alias("found"))
    )
    answers = entries.join(nodes.select(F.col("node").alias("asked"), "embedding"), "asked").select("embedding", "found")
    asking = able.filter(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    # The query's own entry, where it is among the first, is left out.
    at = F.array_position("found", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id")))
    before, after = F.expr("slice(found, 1, int(at) - 1)"), F.expr("slice(found, int(at) + 1, size(found))")
    others = F.when(F.col("at") > 0, F.concat(before, after)).otherwise(F.slice("found", 1, BEST))
    return (
        asking.join(answers, "embedding")
        .select("query_id", "found", at.alias("at"))
        .select("query_id", F.posexplode(others).alias("place", "e"))
        .select("query_id", (F.col("place") + 1).alias("rank"), "e.vec_id", "e.score")
    )


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of the embeddings for every hundredth row."""
    return nearest_vectors(table(spark, sf_dir, "embeddings"))
