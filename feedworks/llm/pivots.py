"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points, in order. Inverted lists
hold, for each pivot, the vectors that name it; vectors that meet in a list and
share enough pivots are verified by their cosine. A pair is counted in the list
of the first pivot both share and nowhere else, so link counts add up without
any pair being written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.llm.components import connected_components
from feedworks.llm.neardup import forest
from feedworks.llm.shared import slices, stored, table, value_at_rank

LEAST_PIVOTS, MOST_PIVOTS = 64, 2048
NAMED = 8
SHARED = 2
COSINE = 0.93
TILE = 1024
MAX_DIMENSIONS = 16

USABLE = (
    "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND "
    "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) "
    "AND exists(embedding, x -> x <> 0)"
)


def usable(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can link, and those that cannot: without id, label or vector,
    zero vectors, NULL or non-finite components."""
    fits = F.coalesce(F.expr(USABLE), F.lit(False))
    return vectors.filter(fits), vectors.filter(~fits)


def choose_pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Reference points for each of the MAX_DIMENSIONS most frequent vector
    lengths: the distinct vectors with the smallest hashes, as many as the square
    root of all of them, at least LEAST_PIVOTS and at most MOST_PIVOTS."""
    lengths = classes.groupBy("dim").count()
    sizes = dict(lengths.orderBy(F.desc("count"), "dim").limit(MAX_DIMENSIONS).collect())
    hashed = classes.select("dim", "node", F.xxhash64("embedding").alias("h"), "embedding")
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        wanted = min(max(math.isqrt(n), LEAST_PIVOTS), MOST_PIVOTS)
        own = hashed.filter(F.col("dim") == dim)
        if n > wanted:
            # Only hashes are ranked. As doubles they keep their order, with ties,
            # so the cut may let a few more vectors through than are wanted.
            ranks = own.select((-F.col("h").cast("double")).alias("v"))
            own = own.filter(F.col("h").cast("double") <= -value_at_rank(ranks, wanted))
        rows = own.orderBy("h", "node").limit(wanted).collect()
        pivots[dim] = unit(np.array([row.embedding for row in rows], float))
    return pivots


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def permutations(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The NAMED nearest pivots of each vector, nearest first, ties by number."""
    return np.argsort(-np.round(vectors @ pivots.T, 12), axis=1, kind="stable")[:, :NAMED]


def describe(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``named``, the ordered nearest pivots. The pivots are bounded: vectors
    of a length that has none name one point, 0, and so meet all of their length,
    tile by tile."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            column = batch.column(batch.schema.get_field_index("embedding"))
            named: list = [None] * batch.num_rows
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) not in pivots:
                    for row in rows:
                        named[row] = [0]
                    continue
                own = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                vectors = unit(own.astype(float).reshape(len(rows), dim))
                for row, order in zip(rows, permutations(vectors, pivots[int(dim)]), strict=True):
                    named[row] = order.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(named, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "named"],
            )

    return classes.mapInArrow(run, f"{fields}, named ARRAY<INT>")


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return unit(np.array(rows.embedding.tolist(), float)), np.array(rows.named.tolist())


def _presence(named: np.ndarray, top: int) -> np.ndarray:
    there = np.zeros((len(named), top), np.float32)
    np.put_along_axis(there, named, 1, 1)
    return there


def compare_list(rows: pd.DataFrame, pivot: int, diagonal: bool, cosine: float = COSINE) -> pd.DataFrame:
    """Links of the vectors of one list, or of two tiles of it: for each vector
    that has any, its number of links and the first row it hangs together with."""
    rows = rows.sort_values(["tile", "node"], ignore_index=True)
    vectors, named = _matrix(rows)
    top = int(named.max()) + 1
    first = np.flatnonzero(rows.tile == rows.tile.min())
    second = first if diagonal else np.flatnonzero(rows.tile != rows.tile.min())
    there = _presence(named, top)
    close = there[first] @ there[second].T >= min(SHARED, named.shape[1])
    close &= vectors[first] @ vectors[second].T >= cosine
    if diagonal:
        close = np.triu(close, 1)
    x, y = np.nonzero(close)
    a, b = first[x], second[y]
    owned = np.empty(len(a), bool)
    for start in range(0, len(a), 1 << 16):
        part = slice(start, start + (1 << 16))
        same = named[a[part]][:, :, None] == named[b[part]][:, None, :]
        shared = np.where(same.any(2), named[a[part]], top)
        owned[part] = shared.min(1) == pivot
    a, b = a[owned], b[owned]
    copies = rows.copies.to_numpy()
    links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
    root = forest(len(rows), a, b)
    linked = np.flatnonzero(links)
    nodes = rows.node.to_numpy()
    return pd.DataFrame(
        {"node": nodes[linked], "links": links[linked].astype(np.int64), "root": nodes[root[linked]]}
    )


def list_links(described: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``node``, ``links``, ``root`` for every list of (label, dim, pivot).

    A list longer than TILE is cut into tiles that meet in pairs, each pair in a
    task of its own, so a crowded pivot is spread and every pair still looked at.
    """
    entries = described.withColumn("pivot", F.explode("named"))
    lists = ["label", "dim", "pivot"]
    lengths = entries.groupBy(*lists).agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")
    )
    tiled = entries.join(lengths, lists).withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    )
    met = tiled.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return compare_list(rows, key[2], key[3] == key[4], cosine)

    return (
        met.select(*lists, "i", "j", "tile", "node", "copies", "embedding", "named")
        .groupBy(*lists, "i", "j")
        .applyInPandas(run, "node BIGINT, links BIGINT, root BIGINT")
    )


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Equal vectors of a label are one node with its number of copies, so copies
    meet once. Rows that cannot link keep their own id as component (NULL for a
    NULL id), no links, and are kept. Rows sharing a vec_id are vectors of their
    own.
    """
    able, unable = usable(vectors.select("vec_id", "embedding", "label"))
    classes = stored(
        able.groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
        .withColumns({"dim": F.size("embedding"), "node": F.monotonically_increasing_id()}),
        "vector-classes",
    )
    described = describe(classes.drop("low"), choose_pivots(classes))
    found = stored(list_links(described, cosine), "vector-links")
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    members = connected_components(edges)
    rooted = (
        classes.select("node", "label", "embedding", "copies", "low")
        .join(totals, "node", "left")
        .join(members, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = rooted.join(lowest, "root").select(
        "label",
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    linked = able.join(answers, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = unable.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
