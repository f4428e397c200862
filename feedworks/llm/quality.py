"""Quality by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all
text, give each document the log of its importance weight: the sum over its
n-grams of log(p_target / p_all). Adding Gumbel noise and taking the top k is
sampling k documents without replacement by weight. k is the number of
documents above the cut that best separates labelled rows.

N-grams run over the shapes of tokens (case, length, punctuation, repetition),
not over the words, so a good text copied many times does not make its own words
look untypical.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.llm.shared import (
    restored,
    set_aside,
    slices,
    stored,
    table,
    value_at_rank,
)

BUCKETS = 1 << 16
ORDER = 3
LABELLED_ROWS = 20_000
SMOOTHING = 1.0
SCALE = 1.0
SEED = 0
CACHED = 1 << 18

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n").findall
# Shapes: 0-35 words, by case and length; from 64 on, punctuation.
_LENGTHS = (0, 1, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 6)
_AGAIN, _TWICE = 1 << 12, 1 << 13


def shape(token: str) -> int:
    """A small number for how a token looks: 12 bits."""
    if token[0].isalnum() or token[0] == "_":
        length = _LENGTHS[len(token)] if len(token) < len(_LENGTHS) else 7
        if token.isdigit():
            case = 0
        elif token.islower():
            case = 1
        elif token.isupper():
            case = 2
        elif token.istitle():
            case = 3
        else:
            case = 4
        return 8 * case + length
    signs = sum(ord(c) * 31**i for i, c in enumerate(token[:4])) + len(token)
    return 64 + signs % 4000


class Features:
    """Hashed n-grams of whole texts; remembers the shapes of a bounded number of tokens."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Bucket of every n-gram of 1 to ORDER tokens."""
        tokens = _TOKEN(text or "")
        if len(self.known) > CACHED:
            self.known = {}
        for token in set(tokens).difference(self.known):
            self.known[token] = shape(token)
        shapes = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        same = np.fromiter(map(hash, tokens), np.int64, len(tokens))
        shapes[1:] += np.uint64(_AGAIN) * (same[1:] == same[:-1])
        shapes[2:] += np.uint64(_TWICE) * (same[2:] == same[:-2])
        grams = []
        for n in range(1, min(ORDER, len(tokens)) + 1):
            run = np.full(len(tokens) - n + 1, n, np.uint64)
            for i in range(n):
                run = run * np.uint64(1 << 14) + shapes[i : len(tokens) - n + 1 + i]
            grams.append(run * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 16))
        return np.concatenate(grams).astype(np.int64) if grams else np.empty(0, np.int64)


def labelled_sample(labels: DataFrame) -> DataFrame:
    """``label_id``, ``quality``: of each quality, LABELLED_ROWS rows, those with
    the smallest hash of their doc_id, and rows equal to the last of them; all if
    there are fewer. Contradicting or NULL labels teach nothing."""
    once = stored(
        labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .drop("most"),
        "quality-labels",
    )
    rank = -F.xxhash64("label_id").cast("double")
    taken = F.lit(True)
    for row in once.groupBy("quality").count().collect():  # at most 2 rows
        if row["count"] > LABELLED_ROWS:
            known = once.filter(F.col("quality") == row.quality)
            least = value_at_rank(known.select(rank.alias("v")), LABELLED_ROWS)
            taken &= (F.col("quality") != row.quality) | (rank >= least)
    return once.filter(taken)


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Add ``quality``; the sample has at most 2 * LABELLED_ROWS rows of two numbers."""
    return docs.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left").drop(
        "label_id"
    )


def learn_weights(labelled: DataFrame) -> np.ndarray:
    """log(p_target / p_all) for each bucket: target counts from rows of
    ``quality`` 1, the other counts from all rows. Tasks send one row for each
    bucket they have seen. Without target rows all weights are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches, 1024):
            for text, quality in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = np.bincount(features(text), minlength=BUCKETS)
                counts[0] += grams
                if quality == 1:
                    counts[1] += grams
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), pa.array(counts[0][seen]), pa.array(counts[1][seen])],
            names=["bucket", "n_all", "n_target"],
        )

    sums = (
        labelled.select("text", "quality")
        .mapInArrow(run, "bucket INT, n_all BIGINT, n_target BIGINT")
        .groupBy("bucket")
        .agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))
        .collect()  # at most BUCKETS rows
    )
    both = np.zeros((2, BUCKETS))
    for row in sums:
        both[:, row.bucket] = row.n_all, row.n_target
    if not both[1].sum():
        return np.zeros(BUCKETS)
    shares = (both + SMOOTHING) / (both.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(shares[1] / shares[0])


def score(labelled: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns plus ``log_weight`` and ``n_grams``; NULL and empty texts
    have none and weigh 0."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in labelled.schema.fields]
    names = labelled.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches, 1024):
            grams = [features(text) for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([float(weights[g].sum()) for g in grams], pa.float64()),
                    pa.array([len(g) for g in grams], pa.int64()),
                ],
                names=[*names, "log_weight", "n_grams"],
            )

    return labelled.mapInArrow(run, ", ".join([*fields, "log_weight DOUBLE", "n_grams BIGINT"]))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight from which on most good and fewest bad rows lie, in the
    middle of the gap; minus infinity without bad rows."""
    if not len(bad) or not len(good):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    gain = np.searchsorted(bad, values) / len(bad) - np.searchsorted(good, values) / len(good)
    best = int(gain.argmax())
    return float(values[best] if best == 0 else (values[best - 1] + values[best]) / 2)


def gumbel(seed: int, *key: str) -> Column:
    """Standard Gumbel noise, a fixed function of the key."""
    bits = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52))
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def resample(scored: DataFrame, seed: int = SEED, scale: float = SCALE) -> DataFrame:
    """Add ``kept``: the top k of log weight plus Gumbel noise.

    ``scored`` must be stored and have ``doc_id``, ``quality``, ``log_weight``.
    k is the number of rows whose weight passes the cut learned from labelled
    rows. Rows equal at the k-th place all stay.
    """
    known = scored.filter("quality IS NOT NULL").select("quality", "log_weight").collect()
    split = [np.array([r.log_weight for r in known if r.quality == q]) for q in (1, 0)]
    cut = best_cut(*split)
    noisy = F.col("log_weight") + scale * gumbel(seed, "doc_id", "log_weight")
    k = scored.filter(F.col("log_weight") >= cut).count()
    if not k:
        return scored.withColumn("kept", F.lit(False))
    least = value_at_rank(scored.select(noisy.alias("v")), k)
    return scored.withColumn("kept", noisy >= least)


def select_quality(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    docs, own = set_aside(docs, "doc_id", "text")
    sample = stored(labelled_sample(labels), "quality-sample")
    labelled = with_labels(docs, sample)
    weights = learn_weights(labelled)
    chosen = resample(stored(score(labelled, weights), "quality-scores"), seed)
    return restored(chosen.filter("kept"), own)


def op4_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and verdict of every document.

    One row per row of documents; NULL texts weigh 0; a NULL doc_id has no
    label; repeated doc_ids are scored each on its own text.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = stored(labelled_sample(table(spark, sf_dir, "labels")), "quality-sample")
    labelled = with_labels(docs, sample)
    weights = learn_weights(labelled)
    scored = score(labelled, weights).select("doc_id", "quality", "log_weight", "n_grams")
    chosen = resample(stored(scored, "quality-scores"))
    return chosen.select("doc_id", "log_weight", "n_grams", "kept")
