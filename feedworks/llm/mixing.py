"""Mixing sources to target weights, in fixed-length blocks.

Texts of a source, laid end to end, are cut into blocks of equally many words.
A source gets as many slots as its target asks for, each slot is thrown into an
output shard at random, so that the source counts of the shards are multinomial,
and slots find their block by a pseudorandom permutation of the source's block
numbers. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedworks.functions.once import computed_once
from feedworks.llm.shared import SPACES, WORD, restored, set_aside, stored, table, whole_text

BLOCK_WORDS = 128
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
CHUNKS = 4096
SLOTS_PER_STEP = 1 << 16
SLOTS_PER_SHARD = 4096
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sid``, ``source``, ``source_size``, ``weight``, ``target`` per source.

    Sources in code point order, NULL last, take ``weights`` in turn and share
    all words. No target exceeds MAX_REPEATS times its source: the level at
    which the rest is shared is the largest that any order of filling gives.
    One row per source passes the windows here, never one per document.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    share = F.array(*[F.lit(w) for w in weights])
    ranked = sources.select(
        F.row_number().over(by_name).alias("sid"), "source", "source_size"
    ).withColumn("weight", share[(F.col("sid") - 1) % len(weights)])
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.lit(MAX_REPEATS) * F.col("source_size")
    everything = Window.partitionBy(F.lit(1))
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    ) / F.sum("weight").over(onwards)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn(
            "target",
            F.least(cap.cast("double"), F.col("level") * F.col("weight")),
        )
        .drop("level")
    )


def place(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``sid``, ``source_size``, ``target`` and ``start``, the words of the
    source before this row.

    Rows of a source are dealt into CHUNKS chunks by ``spread``. A running sum
    within chunks and another over the totals of chunks give the start, so a
    source with most of the rows is never in one task.
    """
    joined = sized.withColumnRenamed("source", "own").join(
        targets, F.col("own").eqNullSafe(F.col("source"))
    ).drop("own")
    chunked = joined.withColumn("chunk", F.pmod("spread", F.lit(CHUNKS)))
    totals = chunked.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
    past = Window.partitionBy("sid").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        "sid", "chunk", F.coalesce(F.sum("words").over(past), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "spread").rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        chunked.withColumn("within", within)
        .join(offsets, ["sid", "chunk"])
        .withColumn("start", F.col("offset") + F.col("within"))
        .drop("chunk", "within", "offset")
    )


def _permuted(position: Column, blocks: Column, sid: Column, epoch: Column) -> Column:
    """A one-to-one map of 0..blocks-1: a multiplier without a common factor,
    one of PRIMES, and an offset drawn for each source and epoch."""
    choice = F.pmod(F.xxhash64(sid, epoch, F.lit(1)), F.lit(len(PRIMES)))
    turned = F.array(*[F.lit(p) for p in PRIMES])[choice.cast("int")]
    spare = F.coalesce(*[F.when(blocks % p != 0, F.lit(p)) for p in PRIMES])
    factor = F.when(blocks % turned != 0, turned).otherwise(spare)
    product = position.cast("decimal(19,0)") * factor.cast("decimal(10,0)")
    shifted = product + F.pmod(F.xxhash64(sid, epoch, F.lit(2)), blocks)
    return (shifted % blocks.cast("decimal(19,0)")).cast("long")


def draw_slots(targets: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``sid``, ``slot``, ``shard`` and ``block`` for every slot of the mix.

    A source whose target is q times its size and some more takes every block q
    times and the right number of blocks once more. Each slot draws its shard,
    which makes the counts of the sources in a shard multinomial, given how many
    slots each source has in all.
    """
    plan = targets.filter("source_size > 0").select(
        "sid",
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        (F.col("target") / F.col("source_size")).alias("times"),
    )
    whole = F.floor("times")
    extra = F.round((F.col("times") - whole) * F.col("blocks")).cast("long")
    plan = plan.withColumn("slots", whole * F.col("blocks") + extra)
    shards = F.greatest(
        F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy(F.lit(1))) / SLOTS_PER_SHARD)
    )
    steps = (
        plan.withColumn("shards", shards)
        .filter("slots > 0")
        .withColumn("first", F.explode(F.expr(f"sequence(0L, slots - 1, {SLOTS_PER_STEP}L)")))
        .repartition("sid", "first")
    )
    last = f"least(first + {SLOTS_PER_STEP}L, slots) - 1"
    slots = steps.withColumn("slot", F.explode(F.expr(f"sequence(first, {last})")))
    epoch, position = F.expr("slot div blocks"), F.expr("slot % blocks")
    return slots.select(
        "sid",
        "slot",
        F.pmod(F.xxhash64(F.lit(seed), "sid", "slot"), F.col("shards")).alias("shard"),
        _permuted(position, F.col("blocks"), F.col("sid"), epoch).alias("block"),
    )


def _blocks_of(start: str, size: str, block_words: int) -> Column:
    """Block numbers a text reaches into."""
    return F.expr(
        f"sequence({start} div {block_words}, ({start} + {size} - 1) div {block_words})"
    )


def _piece_bounds(block: Column, block_words: int) -> tuple[Column, Column]:
    """First word and one past the last, counted within the text."""
    begin = F.greatest(block * block_words, F.col("start"))
    end = F.least((block + 1) * block_words, F.col("start") + F.col("size"))
    return begin - F.col("start"), end - F.col("start")


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each text and block it reaches into: ``block``, ``words``."""
    rows = placed.filter("size > 0").withColumn(
        "block", F.explode(_blocks_of("start", "size", block_words))
    )
    begin, end = _piece_bounds(F.col("block"), block_words)
    return rows.withColumn("words", end - begin)


def mix(placed: DataFrame, targets: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: for each slot, the pieces of texts in its block."""
    # Slots are made from a few rows of targets, which Spark takes for their size.
    slots = draw_slots(targets, seed, block_words).hint("merge")
    return slots.join(pieces(placed, block_words), ["sid", "block"])


def mixed_texts(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``docs``: every piece taken, with the text it covers.

    A piece keeps the white space after its words (the first also that before),
    so the pieces of a text, end to end, are the text. ``n_chars`` is the
    piece's length where ``docs`` has that column. Texts without words are not
    taken; other columns are kept.
    """
    docs, own = set_aside(docs, "doc_id", "text", "source", "n_chars")
    names = docs.columns
    counted = docs.withColumns(
        {
            "size": word_count(whole_text()),
            "spread": F.xxhash64("doc_id", "text"),
        }
    )
    targets = stored(source_targets(counted), "mix-targets")
    placed = place(counted, targets).filter("size > 0")
    boundary = f"(?<=[{SPACES}])(?=[^{SPACES}])"
    parts = placed.withColumn("parts", computed_once(F.split("text", boundary)))
    # Leading white space is an item of its own, not a word.
    lead = F.when(F.col("text").rlike(f"^[{SPACES}]"), 1).otherwise(0)

    def piece(block: Column) -> Column:
        begin, end = _piece_bounds(block, block_words)
        first = F.when(begin == 0, 1).otherwise(begin + 1 + F.col("lead"))
        count = end + F.col("lead") - first + 1
        text = F.array_join(F.slice("parts", first.cast("int"), count.cast("int")), "")
        return F.struct(block.alias("block"), text.alias("text"))

    cut = parts.withColumn("lead", lead).select(
        "sid",
        *[c for c in names if c not in ("text", "n_chars")],
        F.explode(F.transform(_blocks_of("start", "size", block_words), piece)).alias("piece"),
    )
    mixed = draw_slots(targets, seed, block_words).hint("merge").join(
        cut.withColumn("block", F.col("piece.block")), ["sid", "block"]
    )
    values = {"text": F.col("piece.text"), "n_chars": F.length("piece.text").cast("long")}
    return restored(mixed.select(*[values.get(c, F.col(c)).alias(c) for c in names]), own)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document.

    NULL and wordless texts have size 0 and are never taken; a NULL source is a
    source of its own; a row that repeats another is a document of its own.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        word_count(whole_text()).alias("size"),
        F.xxhash64("doc_id", "text").alias("spread"),
    )
    sized = stored(docs, "mix-sizes")
    targets = stored(source_targets(sized), "mix-targets")
    placed = stored(place(sized, targets), "mix-placed")
    row = ["doc_id", "source", "size", "source_size", "target", "sid", "start"]
    taken = mix(placed, targets).select(*row, "words")
    # Documents the mix leaves out count with zero words; words are summed
    # before the shuffle. Rows without words share a start, so they go round it.
    rows = placed.filter("size > 0").select(*row, F.lit(0).cast("long").alias("words"))
    summed = rows.unionByName(taken).groupBy(*row).agg(F.sum("words").alias("taken"))
    wordless = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    result = ["doc_id", "size", "source_size", "target", "taken", "source"]
    return summed.select(*result).unionByName(wordless.select(*result))
