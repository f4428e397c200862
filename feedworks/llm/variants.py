"""Spelling variants by bidirectional FM-index search schemes.

Words that differ by one symbol share their first or their last half. A search
reads either half of a word without error and extends across the other with one
error, on suffix-rank intervals of the delimited vocabulary: from the right in
an index of the words, from the left in an index of the reversed words.

The vocabulary is not held in one place. A word of L symbols lies in the part of
its first (L-1)//2 symbols and in the part of its last L//2; the searches of a
word go to the parts its own halves name, for words of its length and of one
more or less. Parts are hashed into buckets, and a crowded bucket is cut into
tiles of words and of searches that meet in pairs, each pair in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.llm.fmindex import Index, near_words
from feedworks.llm.shared import lower_ascii, stored, table

# Fixed values of the contract.
LETTER = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_COUNT = 2
EDITED = 31
FORM_RATIO = 10

TILE_SYMBOLS = 1 << 16
TILE_SEARCHES = 1 << 14
SEARCHES_HELD = 1 << 12



def edited_words(docs: DataFrame) -> DataFrame:
    """``word``, one row for each run of letters that can give a word: lower-cased,
    and for one in EDITED without one of its code points. A NULL doc_id counts as
    empty text, a NULL text has no runs."""
    runs = F.regexp_extract_all("text", F.lit(f"{LETTER}{{{LEAST_LENGTH},}}"), F.lit(0))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    split = docs.select(own.alias("doc"), F.explode(runs).alias("run"))
    lowered = F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run"))
    hashed = split.select("doc", lowered.alias("run")).select(
        "run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h")
    )
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % EDITED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the words that are long and frequent enough."""
    return (
        edited_words(docs.select("doc_id", "text"))
        .filter(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


def _part(word: Column, length: Column) -> tuple[Column, Column]:
    """What names the parts of words of ``length`` that share either half with
    ``word``: as much of a half as any of them must share."""
    front = F.floor((length - 1) / 2).cast("int")
    back = F.floor(length / 2).cast("int")
    return F.substring(word, F.lit(1), front), F.substring(word, F.length(word) - back + 1, back)


def _placed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (word, n, length) once for each half, with its bucket."""
    front, back = _part(F.col("word"), F.col("length"))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), front.alias("part")),
        F.struct(F.lit(1).alias("half"), back.alias("part")),
    )
    return rows.withColumn("at", F.explode(halves)).select(
        "word", "n", "length", "at.half",
        F.pmod(F.xxhash64("at.half", "length", "at.part"), F.lit(buckets)).alias("bucket"),
    )


def _dealt(rows: DataFrame, tiles: DataFrame, own: str, other: str) -> DataFrame:
    """``rows`` in one of their bucket's ``own`` tiles, for each of its ``other``."""
    return (
        rows.join(tiles, ["half", "bucket"])
        .withColumn(own, F.pmod(F.xxhash64("word", "length"), F.col(own)).cast("int"))
        .withColumn(other, F.explode(F.expr(f"sequence(0, {other} - 1)")))
    )


def search_group(rows: pd.DataFrame, half: int) -> pd.DataFrame:
    """The searches of one group against its words: for each that finds any, how
    many it owns and the most frequent of them. A word that shares both halves'
    symbols belongs to the search from the left."""
    held = rows[~rows.search].sort_values("word", ignore_index=True)
    asked = rows[rows.search]
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    if len(held) and len(asked):
        words, counts = held.word.tolist(), held.n.to_numpy()
        turned = (lambda w: w) if half else (lambda w: w[::-1])
        index = Index(list(map(turned, words)))
        for start in range(0, len(asked), SEARCHES_HELD):
            part = asked.iloc[start : start + SEARCHES_HELD]
            queries = part.word.tolist()
            sizes = np.fromiter(map(len, queries), np.int64, len(queries))
            exact = sizes - sizes // 2 if half else sizes // 2
            change = part.length.to_numpy() - sizes
            query, word = near_words(index, list(map(turned, queries)), exact, change)
            if half:
                mine = [
                    not words[b].startswith(queries[a][: len(queries[a]) // 2])
                    for a, b in zip(query.tolist(), word.tolist(), strict=True)
                ]
                query, word = query[mine], word[mine]
            # Words are numbered in code-point order, so the first of equal counts wins.
            order = np.lexsort((word, -counts[word], query))
            query, word = query[order], word[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            out["word"] += [queries[a] for a in query[first].tolist()]
            out["n_near"] += np.diff(first, append=len(query)).tolist()
            out["best_n"] += counts[word[first]].tolist()
            out["best"] += [words[b] for b in word[first].tolist()]
    return pd.DataFrame(out, dtype=object).astype({"n_near": "int64", "best_n": "int64"})


def near_counts(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``n`` and ``word`` of its most frequent
    near word, the smallest of equal ones) for the words that have near words."""
    symbols = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    buckets = 1 + symbols // TILE_SYMBOLS
    length = F.length("word")
    held = _placed(words.select("word", "n", length.alias("length")), buckets)
    lengths = F.explode(F.array(length - 1, length, length + 1))
    asked = _placed(words.select("word", "n", lengths.alias("length")), buckets)
    where = ["half", "bucket"]
    tiles = held.groupBy(*where).agg(
        F.ceil(F.sum(F.length("word") + 1) / TILE_SYMBOLS).cast("int").alias("tile")
    ).join(
        asked.groupBy(*where).agg(
            F.ceil(F.count(F.lit(1)) / TILE_SEARCHES).cast("int").alias("turn")
        ),
        where,
    )
    met = _dealt(held, tiles, "tile", "turn").withColumn("search", F.lit(False)).unionByName(
        _dealt(asked, tiles, "turn", "tile").withColumn("search", F.lit(True))
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return search_group(rows, key[0])

    # Little data but much work: tasks follow the parts, not the bytes.
    parallel = words.sparkSession.sparkContext.defaultParallelism
    tasks = min(2 * buckets, 32 * parallel)
    found = met.repartition(tasks, *where, "tile", "turn").groupBy(*where, "tile", "turn").applyInPandas(
        run, "word STRING, n_near BIGINT, best_n BIGINT, best STRING"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.struct((-F.col("best.n")).alias("n"), "best.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for every word with a form. Counts grow at least
    FORM_RATIO times from a word to its form, so there is no circle, and as the
    way is doubled in each round a few rounds reach every end."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(reached.join(onward, "root", "left"), "variant-roots")
        reached = moved.select("word", F.coalesce("further", "root").alias("root"))
        if moved.filter("further IS NOT NULL").isEmpty():
            return reached


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of
    ``docs`` (doc_id, text).

    Repeated rows count again; rows without runs of letters, or a table without
    rows, give no words; other columns are not looked at.
    """
    words = stored(vocabulary(docs), "variant-words")
    near = stored(near_counts(words), "variant-near")
    wins = F.col("best.n") >= FORM_RATIO * F.col("n")
    formed = stored(
        words.join(near, "word", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(wins, F.col("best.word")).alias("form"),
            F.when(wins, F.col("best.n")).alias("form_n"),
        ),
        "variant-forms",
    )
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the corpus."""
    return spelling_variants(table(spark, sf_dir, "documents"))
