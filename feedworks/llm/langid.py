"""Language identification by compression.

A raw-content zstandard dictionary is learned for each language. A text is
compressed with every dictionary; the language whose dictionary makes it
smallest wins, and a narrow margin marks the answer as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedworks.llm.shared import remainder, slices, table

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 256
SAMPLE_PARTS = 64
CHARS_PER_DOC = 2048
DICTIONARY_BYTES = 1 << 17
MAX_LANGUAGES = 1000
BLOCK_BYTES = 1 << 13
LEVEL = 3
MIN_MARGIN = 0.01


def letters_only(text: Column) -> Column:
    """Lower case with every run of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def learn_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """One dictionary for each of the ``MAX_LANGUAGES`` most frequent values of
    ``lang``, most frequent first; others are not learned and never predicted.

    The sample is, for each language, the ``DOCS_PER_LANGUAGE`` distinct texts
    with the smallest hash. Of each a piece is taken that begins anywhere in the
    text, at a place its hash names, and all pieces of a language share
    ``DICTIONARY_BYTES`` evenly, at most ``CHARS_PER_DOC`` characters each. Rows
    without text or language, or without letters, teach nothing.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        "lang", F.xxhash64("text").alias("h")
    )
    # Parts of a language are cut first, so that the second cut sees few rows of
    # it however many map tasks there are.
    part = F.pmod("h", F.lit(SAMPLE_PARTS))
    places = [Window.partitionBy("lang", part).orderBy("h"), Window.partitionBy("lang").orderBy("h")]
    picked = known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies"))
    for place in places:
        picked = picked.withColumn("place", F.row_number().over(place)).filter(
            F.col("place") <= DOCS_PER_LANGUAGE
        )
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    learned = sizes.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = learned.collect()
    picked = picked.join(learned, "lang", "left_semi").select("lang", "h")
    letters = letters_only(F.col("text"))
    span = F.greatest(F.length("letters") - CHARS_PER_DOC, F.lit(0)) + 1
    piece = F.substring("letters", F.pmod(F.shiftright("h", 8), span).cast("int") + 1, F.lit(CHARS_PER_DOC))
    sample = (
        docs.select("lang", "text", F.xxhash64("text").alias("h"))
        # At most MAX_LANGUAGES * DOCS_PER_LANGUAGE rows of two short values.
        .join(F.broadcast(picked), ["lang", "h"])
        .select("lang", "h", letters.alias("letters"))
        .groupBy("lang", "h")
        .agg(F.min(piece).alias("t"))
        .orderBy("lang", "h")
    )
    texts: dict[str, list[bytes]] = {row.lang: [] for row in counts}
    for row in sample.toLocalIterator():
        texts[row.lang].append(row.t.encode())
    joined = {lang: b" ".join(_shared(parts)) for lang, parts in texts.items()}
    return {lang: data for lang, data in joined.items() if len(data) >= 8}


def _shared(parts: list[bytes]) -> list[bytes]:
    """The parts, each cut to the same number of bytes where DICTIONARY_BYTES is
    not enough for all; what short ones leave goes to the others."""
    room, cuts = DICTIONARY_BYTES - len(parts), {}
    for left, part in zip(range(len(parts), 0, -1), sorted(parts, key=len), strict=True):
        cuts[part] = min(len(part), max(room, 0) // left)
        room -= cuts[part]
    return [part[: cuts[part]] for part in parts]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(
        dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=content
    )


def _sizes(data: bytes, compressors: list) -> list[int]:
    """Compressed bytes of a text per language, in blocks so that a long text
    cannot become its own dictionary."""
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def classify(data: bytes, names: list[str], compressors: list) -> tuple[str, float, float, bool]:
    """Language, score, margin and whether the margin is too narrow."""
    if not data or not names:
        return UNKNOWN, 0.0, 0.0, True
    sizes = _sizes(data, compressors)
    order = sorted(range(len(names)), key=lambda i: (sizes[i], i))
    best = sizes[order[0]]
    share = sum(2.0 ** max(best - size, -1000) for size in sizes)
    second = sizes[order[1]] if len(order) > 1 else 2 * best
    margin = 1 - best / second
    return names[order[0]], 1 / share, margin, margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *keep: str) -> DataFrame:
    """``keep`` columns plus ``lang_pred``, ``score``, ``margin``, ``rejected``.

    A text that is NULL or has no letter is ``und`` with score 0 and rejected.
    Equal sizes go to the language named first, the most frequent one. Compression works on whole
    texts. The dictionaries' size is bounded by MAX_LANGUAGES.
    """
    names = list(dictionaries)
    picked = docs.select(
        *keep, letters_only(F.coalesce("text", F.lit(""))).cast("binary").alias("letters")
    )
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
        + ["lang_pred STRING", "score DOUBLE", "margin DOUBLE", "rejected BOOLEAN"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [_compressor(dictionaries[name]) for name in names]
        for batch in slices(batches, 2048):
            answers = [
                classify(data, names, compressors)
                for data in batch.column(batch.num_columns - 1).to_pylist()
            ]
            columns = list(zip(*answers, strict=True))
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1]
                + [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.float64()),
                    pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.bool_()),
                ],
                names=[*keep, "lang_pred", "score", "margin", "rejected"],
            )

    return picked.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents not held out.

    One row per row of the table; a NULL doc_id stays NULL and is held out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    dictionaries = learn_dictionaries(docs.filter(~held_out))
    marked = docs.select("doc_id", held_out, "text")
    return identify(marked, dictionaries, "doc_id", "held_out")
