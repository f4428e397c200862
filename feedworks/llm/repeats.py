"""Removing repeated passages: exact, by sparse suffix sorting.

A window is any string of WINDOW bytes inside one text. Every window holds an
anchor, its lowest-hashed group of GRAM bytes, and equal windows hold equal
anchors at equal places. Neighbouring windows with the same anchor form a run;
only runs that share an anchor with another can hold repeated windows. Runs that
are equal as a whole are repeated. Runs that share no more than an anchor are
ordered by what follows the anchor and, reversed, by what precedes it, with
deep-shallow sorting; common prefixes of neighbours then tell for every window
whether another run holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.llm.shared import (
    as_bytes,
    restored,
    set_aside,
    slices,
    stored,
    table,
    whole_text,
)
from feedworks.llm.suffixsort import deep_shallow_sort

WINDOW = 400
GRAM = 16
SEGMENT = 1 << 19
MOST_CLASSES = 4096
RUNS_AT_ONCE = 20_000
BUCKET_RUNS = 50_000
_PLACE = np.uint64((1 << 20) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(data: bytes, window: int = WINDOW) -> Iterator[tuple[int, int, int, int]]:
    """``start``, ``count``, ``anchor``, ``place`` of each run of windows: the
    first window's start, how many windows, the anchor's hash, and how far the
    anchor lies from ``start``. Long texts are taken in segments."""
    total = len(data) - window + 1
    for begin in range(0, total, SEGMENT):
        count = min(SEGMENT, total - begin)
        size = count + window - 1
        raw = np.frombuffer(data, np.uint8, size, begin)
        words = np.ndarray((size - 7,), "<u8", raw, strides=(1,))
        grams = _mixed(words[: size - 15]) + words[8:] * np.uint64(0xD6E8FEB86659FD93)
        hashes = _mixed(grams)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        reach, width = window - GRAM + 1, 1
        low = keys
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[: count], low[reach - width : reach - width + count])
        places = (low[:count] & _PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
        counts = np.diff(np.concatenate([starts, [count]]))
        at = places[starts]
        anchors = hashes[at].view(np.int64)
        for s, n, a, p in zip(starts.tolist(), counts.tolist(), anchors.tolist(), at.tolist(), strict=True):
            yield begin + s, n, a, p - s


def find_runs(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """All runs of all texts: ``k1``, ``k2`` name the text, ``c1``, ``c2`` the
    run's content and anchor place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: list[list] = [[] for _ in range(8)]
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True)
            for k1, k2, data in keys:
                for start, count, anchor, place in runs(data, window):
                    content = data[start : start + count + window - 1]
                    c = xxhash.xxh3_128_intdigest(content, place)
                    row = (k1, k2, start, count, anchor, place, (c >> 64) - (1 << 63), (c & (1 << 64) - 1) - (1 << 63))
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                names=["k1", "k2", "start", "count", "anchor", "place", "c1", "c2"],
            )

    return texts.select("k1", "k2", "text").mapInArrow(
        run,
        "k1 BIGINT, k2 BIGINT, start BIGINT, count INT, anchor BIGINT, place INT, c1 BIGINT, c2 BIGINT",
    )


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def shared_windows(
    anchors: np.ndarray, contents: list[bytes], places: np.ndarray, counts: np.ndarray, window: int = WINDOW
) -> np.ndarray:
    """For each run (row) and window of it (column): does another of these runs
    hold it? Runs of different anchors share nothing."""
    ahead = [c[p:] for c, p in zip(contents, places.tolist(), strict=True)]
    behind = [c[:p][::-1] for c, p in zip(contents, places.tolist(), strict=True)]
    right, right_prefix = deep_shallow_sort(ahead, anchors)
    left, left_prefix = deep_shallow_sort(behind, anchors)
    size = len(contents)
    found = np.zeros((size, int(counts.max())), bool)
    right_class, left_class = np.empty(size, np.int64), np.empty(size, np.int64)
    for before in range(int(places.max()) + 1):
        # Windows that start ``before`` bytes ahead of their anchor.
        at = places - before
        rows = np.flatnonzero((at >= 0) & (at < counts))
        if len(rows) < 2:
            continue
        right_class[right] = np.cumsum(right_prefix < window - before)
        left_class[left] = np.cumsum(left_prefix < before)
        key = right_class[rows] * (size + 1) + left_class[rows]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(rows), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        rows = rows[twice]
        found[rows, at[rows]] = True
    return found


_SPANS = "anchor BIGINT, c1 BIGINT, c2 BIGINT, spans ARRAY<STRUCT<a: INT, b: INT>>"
_SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _compare_runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor, compared group by group, some groups at once."""
    held: list[pa.RecordBatch] = []

    def answer(rows: pa.Table) -> pa.RecordBatch:
        anchors, c1, c2, counts, places = (
            rows.column(i).to_numpy() for i in range(5)
        )
        found = shared_windows(anchors, rows.column(5).to_pylist(), places, counts, window)
        spans = []
        for flags, count in zip(found, counts, strict=True):
            spans.append([{"a": a, "b": b} for a, b in zip(*(x.tolist() for x in spans_of(flags[:count])), strict=True)])
        some = np.array([bool(s) for s in spans])
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors[some]), pa.array(c1[some]), pa.array(c2[some]), pa.array([s for s in spans if s], _SPAN_TYPE)],
            names=["anchor", "c1", "c2", "spans"],
        )

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= RUNS_AT_ONCE:
            rows = pa.Table.from_batches(held)
            anchors = rows.column(0).to_numpy()
            ready = int(np.searchsorted(anchors, anchors[-1]))
            if ready:
                yield answer(rows.slice(0, ready))
                held = rows.slice(ready).combine_chunks().to_batches()
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and rows.num_rows:
        yield answer(rows)


def _window_hashes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One row for each window of a run, named by 128 bits of its content."""
    for batch in slices(batches, 256):
        anchor, c1, c2, counts = (batch.column(i).to_pylist() for i in range(4))
        contents = batch.column(5).to_pylist()
        out: list[tuple] = []
        for a, x, y, n, content in zip(anchor, c1, c2, counts, contents, strict=True):
            out += [(a, x, y, o, xxhash.xxh3_128_digest(content[o : o + window])) for o in range(n)]
        columns = zip(*out, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["anchor", "c1", "c2", "at", "w"],
        )


def repeated_spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``k1``, ``k2`` and ``spans``, the byte ranges to remove, for the texts
    that have any.

    ``texts`` has ``text`` and the 128 bits ``k1``, ``k2`` that name it; equal
    texts are one. Runs are counted by content before they are compared, so
    copies in any number meet once. An anchor with more than MOST_CLASSES
    different runs is not taken into one task: its windows are counted one by
    one.
    """
    class_key = ["anchor", "c1", "c2"]
    found = stored(find_runs(texts, window), "runs")
    classes = stored(
        found.groupBy(*class_key).agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("k1", "k2", "start", "count", "place")).alias("at"),
        ),
        "run-classes",
    )
    sizes = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    mixed = classes.join(sizes, "anchor").select(*class_key, "classes", "at.*")
    wanted = mixed.groupBy("k1", "k2").agg(
        F.collect_list(F.struct(*class_key, "count", "place", "start", "classes")).alias("runs")
    )
    distinct = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    pieces = (
        wanted.join(distinct, ["k1", "k2"])
        .select(F.col("text").cast("binary").alias("data"), F.explode("runs").alias("r"))
        .select(
            *[f"r.{c}" for c in (*class_key, "count", "place")],
            F.expr(f"substring(data, int(r.start) + 1, r.count + {window - 1})").alias("content"),
            "r.classes",
        )
    )
    pieces = stored(pieces, "run-contents")
    narrow = pieces.filter(F.col("classes") <= MOST_CLASSES).drop("classes")
    small = (
        narrow.repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(lambda b: _compare_runs(b, window), _SPANS)
    )
    windows = (
        pieces.filter(F.col("classes") > MOST_CLASSES)
        .drop("classes")
        .mapInArrow(
            lambda b: _window_hashes(b, window),
            "anchor BIGINT, c1 BIGINT, c2 BIGINT, at INT, w BINARY",
        )
    )
    twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w")
    large = (
        windows.join(twice, "w")
        .groupBy(*class_key)
        .agg(
            F.collect_list(
                F.struct(F.col("at").alias("a"), (F.col("at") + 1).cast("int").alias("b"))
            ).alias("spans")
        )
    )
    whole = classes.filter("copies > 1").select(
        *class_key,
        F.array(F.struct(F.lit(0).alias("a"), F.col("at.count").alias("b"))).alias("spans"),
    )
    partial = small.unionByName(large).join(
        classes.filter("copies = 1").select(*class_key), class_key, "left_semi"
    )
    resolved = stored(whole.unionByName(partial), "run-spans")
    return spans_by_text(found.select("k1", "k2", "start", *class_key), resolved, window)


def spans_by_text(found: DataFrame, resolved: DataFrame, window: int) -> DataFrame:
    """``k1``, ``k2``, ``spans`` of the texts that hold resolved classes.

    A passage that many texts share makes many runs of few classes. Texts are
    dealt to buckets, and a class is joined once to each bucket that has it, not
    once to each run; within a bucket, whose size is bounded, runs look it up.
    """
    class_key = ["anchor", "c1", "c2"]
    buckets = 1 + found.count() // BUCKET_RUNS
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets)).cast("int"))
    known = stored(dealt.select("bucket", *class_key).distinct().join(resolved, class_key), "bucket-spans")

    def look_up(runs: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        number = {key: i for i, key in enumerate(zip(*(classes[c].tolist() for c in class_key), strict=True))}
        spans = [[(s["a"], s["b"] + window - 1) for s in some] for some in classes.spans]
        texts: dict[tuple[int, int], list] = {}
        for key, place, start in zip(
            zip(*(runs[c].tolist() for c in class_key), strict=True),
            zip(runs.k1.tolist(), runs.k2.tolist(), strict=True),
            runs.start.tolist(),
            strict=True,
        ):
            at = number.get(key)
            if at is not None:
                texts.setdefault(place, []).extend((start + a, start + b) for a, b in spans[at])
        # Copies of a text give the same spans again.
        merged = [[{"a": a, "b": b} for a, b in cut(b"", x)[1]] for x in texts.values()]
        out = {"k1": [k for k, _ in texts], "k2": [k for _, k in texts], "spans": merged}
        return pd.DataFrame(out, dtype=object).astype({"k1": "int64", "k2": "int64"})

    return dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(
        look_up, "k1 BIGINT, k2 BIGINT, spans ARRAY<STRUCT<a: BIGINT, b: BIGINT>>"
    )


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the merged spans that went."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    kept, at = [], 0
    for a, b in merged:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), merged


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` plus ``kept`` (binary), ``left`` (the same as text,
    of a character cut in two nothing) and ``removed`` (merged byte spans).
    Repeats are judged on the input, same text included; NULL counts as empty;
    texts shorter than the window lose nothing."""
    names = docs.columns
    text = whole_text()
    keys = [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]
    keyed = docs.select(*names, *keys)
    texts = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), text.alias("text"))
    spans = stored(repeated_spans(texts, window), "text-spans").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans")
    )
    joined = keyed.join(spans, ["__k1", "__k2"], "left").select(*names, "__spans")
    at = names.index("text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            lists = batch.column(batch.num_columns - 1).to_pylist()
            done = [
                cut(data, [(s["a"], s["b"]) for s in spans or ()])
                for data, spans in zip(as_bytes(batch.column(at)), lists, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([d[0] for d in done], pa.binary()),
                    pa.array([d[0].decode("utf-8", "ignore") for d in done], pa.string()),
                    pa.array([[{"a": a, "b": b} for a, b in d[1]] for d in done], kind),
                ],
                names=[*names, "kept", "left", "removed"],
            )

    return joined.mapInArrow(
        run, ", ".join([*fields, "kept BINARY", "left STRING", "removed ARRAY<STRUCT<a: BIGINT, b: BIGINT>>"])
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_chars``, if
    there, to match. NULL texts stay NULL; texts of which nothing is left stay
    as empty texts."""
    docs, own = set_aside(docs, "text", "n_chars")
    text = F.when(F.col("text").isNull() | (F.size("removed") == 0), F.col("text")).otherwise(F.col("left"))
    done = remove_repeats(docs, window).withColumn("text", text)
    if "n_chars" in own.values():
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return restored(done, own)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and what is left, also as text.

    One row per row of the table; NULL and empty texts have no bytes.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeats(docs)
    removed = F.aggregate(
        "removed", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"]
    )
    return done.select(
        "doc_id",
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("left").alias("kept_text"),
    )
