"""Ranked lexical search by NRA: sequential reads of impact-sorted lists.

The index is cut into segments of documents. In a segment every term of an item
has a list of documents, highest impact first. Lists are read from the front in
growing blocks; a document's score lies between what was read of it and that plus
what lists it was not yet read from can still hold. Reading goes on until no
document outside the best can reach or tie them and every one of the best is
known to its last unit. Scores do not depend on the segment, so the best of all
segments are the best of all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedworks.llm.shared import as_bytes, lower_ascii, slices, stored, table

# Fixed values of the contract.
NOT_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{NOT_TERM}]+"
BEST = 10
SCALE = 1_000_000_000
LENGTH_SHARE = 75
SATURATION = 8

SEGMENT_DOCUMENTS = 1 << 14
SEGMENT_TERMS = 1 << 22
ITEMS_TOGETHER = 256
FIRST_READ = 64
SIEVE_BITS = 20

_TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``item`` (a number) and ``item_id`` of every row, and ``item``, ``term``,
    ``times`` of its terms."""
    numbered = stored(
        items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "search-items"
    )
    terms = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    counted = numbered.select("item", F.explode(terms).alias("term")).groupBy("item", "term")
    return numbered.select("item", "item_id"), stored(
        counted.agg(F.count(F.lit(1)).alias("times")), "search-terms"
    )


def sieve(terms: DataFrame) -> np.ndarray:
    """A bit for every possible remainder of a term's crc32, set where an item has
    such a term: its size does not follow the items."""
    bits = np.zeros(1 << SIEVE_BITS, bool)
    places = (F.crc32(F.col("term").cast("binary")) % (1 << SIEVE_BITS)).cast("int").alias("b")
    bits[[row.b for row in terms.select(places).distinct().collect()]] = True
    return bits


def segments(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """The index: for each segment one row without ``term`` that holds ``ids`` and
    lengths (``counts``) of its documents and the places of those without an id
    (``missing``), and one row for each term that passes the sieve, with the
    documents' numbers in the segment and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        number = 0
        ids: list[int] = []
        sizes: list[int] = []
        missing: list[int] = []
        lists: dict[bytes, tuple[list[int], list[int]]] = {}
        passes: dict[bytes, bool] = {}
        held = 0

        def segment() -> Iterator[pa.RecordBatch]:
            yield _rows(part + number, [None], [ids], [sizes], [missing])
            names = list(lists)
            for start in range(0, len(names), 4096):
                some = names[start : start + 4096]
                yield _rows(
                    part + number, some, [lists[t][0] for t in some], [lists[t][1] for t in some], [None] * len(some)
                )

        for batch in slices(batches, 1024):
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                counts = Counter(_TERM_BYTES.findall(data.lower()))
                for term, times in counts.items():
                    fits = passes.get(term)
                    if fits is None:
                        if len(passes) > SEGMENT_TERMS // 8:
                            passes.clear()
                        fits = passes[term] = bool(bits[zlib.crc32(term) & (len(bits) - 1)])
                    if fits:
                        rows, tfs = lists.setdefault(term, ([], []))
                        rows.append(len(ids))
                        tfs.append(times)
                        held += 1
                if doc_id is None:
                    missing.append(len(ids))
                ids.append(doc_id or 0)
                sizes.append(counts.total())
                if len(ids) == SEGMENT_DOCUMENTS or held > SEGMENT_TERMS:
                    yield from segment()
                    number += 1
                    held = 0
                    ids, sizes, missing, lists = [], [], [], {}
        if ids:
            yield from segment()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "segment BIGINT, term STRING, ids ARRAY<BIGINT>, counts ARRAY<BIGINT>, missing ARRAY<BIGINT>"
    )


def _rows(segment: int, terms: list, ids: list, counts: list, missing: list) -> pa.RecordBatch:
    texts = pa.array([None if t is None else t.decode() for t in terms], pa.string())
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([segment] * len(terms), pa.int64()), texts, *(pa.array(x, longs) for x in (ids, counts, missing))],
        names=["segment", "term", "ids", "counts", "missing"],
    )


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """Documents that are among the ``best`` of ``size`` or tie with the last of
    them, and their scores, which are exact; documents without a score are left
    out. Each list holds documents and scores, highest first."""
    low = np.zeros(size, np.int64)
    deep, step = [0] * len(lists), FIRST_READ
    while True:
        rest = np.zeros(size, np.int64)
        total = 0
        for k, (rows, scores) in enumerate(lists):
            start, stop = deep[k], min(deep[k] + step, len(rows))
            low[rows[start:stop]] += scores[start:stop]
            deep[k] = stop
            if stop < len(rows):
                # Where the list was not read from, it holds at most the last score read.
                last = scores[stop - 1]
                total += last
                rest[rows[:stop]] -= last
        rest += total
        seen = low[low > 0]
        bar = np.partition(seen, len(seen) - best)[len(seen) - best] if len(seen) > best else 0
        open_ = (low + rest >= max(bar, 1)) & (rest > 0)
        if not open_.any():
            found = np.flatnonzero(low >= max(bar, 1))
            return found, low[found]
        step *= 2


def search_segment(rows: pd.DataFrame, n_docs: int, n_terms: int) -> pd.DataFrame:
    """The best documents of one segment for each item of one block."""
    head = rows.term.isna().to_numpy()
    out: dict[str, list] = {"item": [], "doc_id": [], "score": []}
    if head.any() and not head.all():
        own = rows[head].iloc[0]
        ids, sizes = np.asarray(own.ids, np.int64), np.asarray(own.counts, np.int64)
        missing = np.zeros(len(ids), bool)
        missing[np.asarray(own.missing, np.int64)] = True
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * n_docs) // n_terms
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for where, counts, weight, uses in rows.loc[~head, ["ids", "counts", "weight", "uses"]].itertuples(index=False):
            where, tf = np.asarray(where, np.int64), np.asarray(counts, np.int64)
            impact = (SCALE * tf) // (1000 * tf + SATURATION * m[where])
            order = np.argsort(-impact, kind="stable")
            where, scores = where[order], int(weight) * impact[order]
            for use in uses:
                asked.setdefault(use["item"], []).append((where, scores * use["times"]))
        for item, lists in asked.items():
            found, scores = nra(lists, len(ids))
            best = np.lexsort((ids[found], missing[found], -scores))[:BEST]
            out["item"] += [item] * len(best)
            out["score"] += scores[best].tolist()
            out["doc_id"] += [None if missing[k] else int(ids[k]) for k in found[best]]
    return pd.DataFrame(out).astype({"item": "int64", "doc_id": "Int64", "score": "int64"})


def ranked_search(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the BEST documents (doc_id,
    text) of every item (item_id, text) with a score above 0, highest first, equal
    scores by ascending doc_id, NULL last.

    Every row is an item or a document of its own, also where ids repeat or are
    NULL. NULL and empty texts hold no term, count for nothing and are not found.
    Items without terms, and all items of a table without documents, have no rows.
    """
    numbered, terms = item_terms(items)
    index = stored(segments(docs, sieve(terms)), "search-segments")
    heads, lists = index.filter("term IS NULL"), index.filter("term IS NOT NULL")
    n_docs, n_terms = heads.select(F.explode("counts").alias("n")).agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    found = lists.join(terms.select("term").distinct(), "term", "left_semi")
    df = found.groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    blocks = 1 + numbered.count() // ITEMS_TOGETHER
    uses = stored(
        terms.join(df.select("term", weight.alias("weight")), "term")
        # Terms that nearly all documents hold weigh nothing and add nothing.
        .filter("weight > 0")
        .groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "term", "weight")
        .agg(F.collect_list(F.struct("item", "times")).alias("uses")),
        "search-uses",
    )
    met = lists.join(uses, "term").unionByName(
        heads.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks - 1})"))), allowMissingColumns=True
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return search_segment(rows, n_docs, n_terms)

    parallel = docs.sparkSession.sparkContext.defaultParallelism
    best = met.repartition(32 * parallel, "segment", "block").groupBy("segment", "block").applyInPandas(
        run, "item BIGINT, doc_id BIGINT, score BIGINT"
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BEST)
    return ranked.join(numbered, "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of the corpus for every benchmark item."""
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
