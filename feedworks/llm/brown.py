"""Language-model scores from a Brown class-based bigram model.

Exchange clustering puts words into classes; a text's probability is the product
of class transitions and of words within their class. It starts on the driver
from the most frequent words and groups of the others by ending. Then every word
of the training texts moves by itself in Spark: the words of the broadcast
vocabulary in passes over their neighbours' counts, the words beyond it in one
pass over theirs. Counts of all words are exact and kept in a stored table; only
counts of bounded size reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedworks.llm.shared import (
    as_bytes,
    remainder,
    slices,
    stored,
    table,
    value_at_rank,
    whole_text,
)
from feedworks.sources.storage import delete, scratch_path

OWN_ITEMS = 1024
ENDINGS = 256
ENDING_BYTES = 3
END = OWN_ITEMS + ENDINGS
ITEMS = END + 1
CLASSES = 64
ROUNDS = 8
PASSES = 2
FEWER_AT_ONCE = 4
LOOKED_UP = 1 << 17
COUNTED_AT_ONCE = 1 << 19
SCANNED_AT_ONCE = 1 << 21
GROUPED_AT_ONCE = 1 << 15
PART_WORDS = 1 << 18
SORTED_AT_ONCE = 10000
MOVED_AT_ONCE = 64
ADDED = 0.1
PRIOR = 5.0
UNSEEN = 0.5
SPELLING_ADDED = 0.1


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def ending(word: bytes) -> int:
    return OWN_ITEMS + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def count_words(texts: DataFrame) -> DataFrame:
    """``word``, ``c``: exact counts; a task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "c"],
            )

        seen: Counter = Counter()
        for batch in slices(batches, 64):
            for data in as_bytes(batch.column(0)):
                seen.update(words_of(data))
            if len(seen) > COUNTED_AT_ONCE:
                yield flushed()
                seen = Counter()
        yield flushed()

    return (
        texts.select("text").mapInArrow(run, "word BINARY, c BIGINT").groupBy("word").agg(F.sum("c").alias("c"))
    )


def most_frequent(counts: DataFrame, distinct: int) -> list:
    """At most LOOKED_UP words, all that are more frequent than the first left
    out. A limit of that size would bring as many rows from every task."""
    if distinct > LOOKED_UP:
        least = value_at_rank(counts.select(F.col("c").cast("double").alias("v")), LOOKED_UP)
        counts = counts.filter(F.col("c") > least)
    return sorted(counts.collect(), key=lambda row: (-row.c, bytes(row.word)))


class Vocabulary:
    """The most frequent words with their counts, at most LOOKED_UP of them; the
    first OWN_ITEMS are items of their own.

    Ids name its words by place, then the endings of other words, then the end.
    """

    def __init__(self, rows: list):
        self.place = {bytes(row.word): i for i, row in enumerate(rows)}
        self.counts = np.array([row.c for row in rows], float)
        self.items = np.array(
            [i if i < OWN_ITEMS else ending(bytes(row.word)) for i, row in enumerate(rows)], np.int64
        )
        self.size = len(rows)
        self.end = self.size + ENDINGS
        self.item_of_id = np.concatenate([self.items, np.arange(OWN_ITEMS, ITEMS)])
        # Parts that the work on all neighbours is dealt to; they grow with the texts.
        self.parts = 1 + int(self.counts.sum()) // PART_WORDS

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Id of each word, and which words are not among them."""
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        others = np.flatnonzero(ids < 0)
        for i in others.tolist():
            ids[i] = self.size + ending(words[i]) - OWN_ITEMS
        return ids, others


def _listed(starts: np.ndarray, lists: dict[str, pa.Array], first: pa.Array, name: str) -> pa.RecordBatch:
    """One row for each of ``starts``: ``first`` as ``name``, then what each of
    ``lists`` holds from there to the next of them."""
    size = max(map(len, lists.values()))
    offsets = pa.array(np.append(starts, size), pa.int32())
    columns = [
        pa.ListArray.from_arrays(offsets, values) if len(values) else pa.nulls(len(starts), pa.list_(values.type))
        for values in lists.values()
    ]
    return pa.RecordBatch.from_arrays([first, *columns], names=[name, *lists])


_PARTS = (
    "part INT, n ARRAY<BIGINT>, key ARRAY<BIGINT>, own ARRAY<INT>, left ARRAY<INT>, right ARRAY<INT>, next ARRAY<BIGINT>"
)


def neighbours(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What stands side by side, the end before and after every text, in lists
    dealt to parts of about PART_WORDS words. Of two kinds: ``n`` times the ids
    ``left`` and ``right``, added up in part, which lie in the part of the less
    frequent id, so a frequent one does not make a large part; and occurrences of
    words that are not in the vocabulary, with their hash as ``key``, in the part of
    its range, their id ``own``, the ids ``left`` and ``right``, and in ``next`` the
    hash of the word after it, if that is not in the vocabulary either."""
    size, end, parts = vocabulary.size, vocabulary.end, vocabulary.parts
    names = ("n", "key", "own", "left", "right", "next")
    nothing = {c: pa.array([], pa.int64() if c in ("n", "key", "next") else pa.int32()) for c in names}

    def pairs(line: np.ndarray) -> pa.RecordBatch:
        left, right = line[:-1], line[1:]
        # Ids follow their frequency; endings and the end come before all of them.
        rank = np.where(line < size, line, line - end - 1)
        part = np.maximum(rank[:-1], rank[1:]) % parts
        found, n = np.unique((part * (end + 1) + left) * (end + 1) + right, return_counts=True)
        found, right = np.divmod(found, end + 1)
        part, left = np.divmod(found, end + 1)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        lists = {"n": pa.array(n), "left": pa.array(left, pa.int32()), "right": pa.array(right, pa.int32())}
        return _listed(starts, nothing | lists, pa.array(part[starts], pa.int32()), "part")

    def occurrences(line: np.ndarray, at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        part = ((keys >> 32) + (1 << 31)) * parts >> 32
        order = np.argsort(part, kind="stable")
        part, at = part[order], at[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        other = (line[at + 1] >= size) & (line[at + 1] < end)
        follows = pa.array(np.roll(keys, -1)[order], mask=~other)
        lists = {"key": pa.array(keys[order]), "next": follows}
        lists |= {name: pa.array(line[at + d], pa.int32()) for name, d in (("own", 0), ("left", -1), ("right", 1))}
        return _listed(starts, nothing | lists, pa.array(part[starts], pa.int32()), "part")

    def answer(texts_: list[np.ndarray], hashes: list[int]) -> Iterator[pa.RecordBatch]:
        line = np.concatenate(texts_)
        yield pairs(line)
        at = np.flatnonzero((line >= size) & (line < end))
        if len(at):
            yield occurrences(line, at, np.array(hashes, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.array([end])
        held_texts, hashes, held = [limit], [], 0
        for batch in slices(batches, 64):
            for data in as_bytes(batch.column(0)):
                words = words_of(data)
                ids, others = vocabulary.ids_of(words)
                held_texts += [ids, limit]
                hashes += [xxhash.xxh64_intdigest(words[i], 42) for i in others.tolist()]
                held += len(words) + 1
            if held >= SCANNED_AT_ONCE:
                yield from answer(held_texts, hashes)
                held_texts, hashes, held = [limit], [], 0
        if held:
            yield from answer(held_texts, hashes)

    return texts.select("text").mapInArrow(run, _PARTS)


def _added_up(df: DataFrame, run, size: int) -> np.ndarray:
    """The sum over all tasks of the numbers that ``run`` gives for their batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            at, n = run(batch)
            np.add.at(total, at, n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["at", "n"])

    found = df.mapInArrow(task, "at INT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(size)
    result[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return result


def count_pairs(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often item v follows item u, with END before and after every text."""
    return class_table(contexts(neighbours(texts, vocabulary), vocabulary), vocabulary.item_of_id, ITEMS)


def rare_totals(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Per item: occurrences and number of words; words seen once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, ITEMS), np.int64)
        for batch in batches:
            items = np.array([ending(w) for w in batch.column(0).to_pylist()], np.int64)
            c = batch.column(1).to_numpy()
            totals[0] += np.bincount(items, c, ITEMS).astype(np.int64)
            totals[1] += np.bincount(items, minlength=ITEMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(ITEMS, dtype=np.int32)), pa.array(totals[0]), pa.array(totals[1])],
            names=["item", "n", "v"],
        )

    rows = (
        counts.mapInArrow(run, "item INT, n BIGINT, v BIGINT")
        .groupBy("item").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    )
    n, v = np.zeros(ITEMS), np.zeros(ITEMS)
    for row in rows:
        n[row.item], v[row.item] = row.n, row.v
    once, twice = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    return n, v, once, twice


def spelling(counts: DataFrame) -> np.ndarray:
    """log10 of the probability that a byte follows another in a word, learned from
    the distinct words; a line feed, which no word holds, begins and ends them.
    Words of any spelling together have a probability of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follows = np.zeros(1 << 16, np.int64)
        for batch in slices(batches, 1 << 14):
            line = _spelled(batch.column(0).to_pylist())
            follows += np.bincount(line[:-1] * 256 + line[1:], minlength=1 << 16)
        seen = np.flatnonzero(follows)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(follows[seen])], names=["pair", "n"])

    rows = counts.select("word").mapInArrow(run, "pair INT, n BIGINT").groupBy("pair").agg(F.sum("n").alias("n"))
    follows = np.full(1 << 16, SPELLING_ADDED)
    for row in rows.collect():
        follows[row.pair] += row.n
    follows = follows.reshape(256, 256)
    return np.log10(follows / follows.sum(1, keepdims=True))


def _spelled(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"\n" + b"".join(w + b"\n" for w in words), np.uint8).astype(np.int64)


def spell(words: list[bytes], letters: np.ndarray) -> list[float]:
    """log10 of each word's probability by its spelling."""
    if not words:
        return []
    line = _spelled(words)
    steps = letters[line[:-1], line[1:]]
    return np.add.reduceat(steps, np.flatnonzero(line[:-1] == 10)).tolist()


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """A class for each item, by exchange: items, most frequent first, move to
    the class that raises the likelihood of the class bigrams most, until none
    moves or ``rounds`` are done."""
    size = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    member = np.empty(size, np.int64)
    member[order] = np.arange(size) % classes
    one_hot = np.zeros((size, classes))
    one_hot[np.arange(size), member] = 1
    table_ = one_hot.T @ pairs @ one_hot
    for _ in range(rounds):
        moved = 0
        for item in order.tolist():
            after = np.bincount(member, pairs[item], classes)
            before = np.bincount(member, pairs[:, item], classes)
            if not after.any() and not before.any():
                continue
            own, twice = member[item], pairs[item, item]
            after[own] -= twice
            before[own] -= twice
            table_[own, :] -= after
            table_[:, own] -= before
            table_[own, own] -= twice
            now = _xlogx(table_)
            rows = _xlogx(table_ + after) - now
            columns = _xlogx(table_ + before[:, None]) - now
            corner = np.diag(table_)
            gain = rows.sum(1) - np.diag(rows) + columns.sum(0) - np.diag(columns)
            gain += _xlogx(corner + after + before + twice) - np.diag(now)
            left, right = table_.sum(1), table_.sum(0)
            gain -= _xlogx(left + after.sum() + twice) - _xlogx(left)
            gain -= _xlogx(right + before.sum() + twice) - _xlogx(right)
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            member[item] = best
            table_[best, :] += after
            table_[:, best] += before
            table_[best, best] += twice
        if not moved:
            break
    return member


def _f(x: np.ndarray) -> np.ndarray:
    """x * log(x) of whole numbers; none of its terms for 0 and 1."""
    x = np.maximum(x, 1.0)
    return x * np.log(x)


def _line_gains(table_: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word and class, what the class's line of ``table_`` gains if the
    word leaves its own class and joins that one, the corner left out."""
    classes = len(table_)
    result = np.zeros(after.shape)
    word, other = np.nonzero(after)
    if not len(word):
        return result
    n, from_ = after[word, other], own[word]
    # Many words have the same count beside the same class.
    same, at = np.unique(n.astype(np.int64) * classes + other, return_inverse=True)
    cells = table_[:, same % classes].T
    gains = (_f(cells + (same // classes)[:, None]) - _f(cells))[at]
    each = np.arange(len(word))
    gains[each, from_] = _f(table_[from_, other]) - _f(table_[from_, other] - n)
    mine = np.flatnonzero(other == from_)
    cells = table_[:, from_[mine]].T - before[word[mine]]
    gains[mine] = _f(cells + n[mine, None]) - _f(cells)
    gains[each, other] = 0
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    result[word[starts]] = np.add.reduceat(gains, starts)
    return result


def best_classes(
    table_: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, own: np.ndarray
) -> np.ndarray:
    """The class that raises the likelihood of ``table_`` most for each word if it
    alone moves there. ``after`` and ``before`` count its neighbours by class,
    ``twice`` how often it follows itself, in neither of them."""
    gain = _line_gains(table_, after, before, own) + _line_gains(table_.T, before, after, own)
    both = after + before + twice[:, None]
    word, k = np.nonzero(both)
    n = both[word, k]
    corner = table_[k, k] - np.where(k == own[word], n, 0)
    gain[word, k] += _f(corner + n) - _f(corner)
    each = np.arange(len(own))
    for side, total in ((table_.sum(1), after.sum(1) + twice), (table_.sum(0), before.sum(1) + twice)):
        totals, at = np.unique(total, return_inverse=True)
        lost = (_f(side + totals[:, None]) - _f(side))[at]
        lost[each, own] = _f(side[own]) - _f(side[own] - total)
        gain -= lost
    best = gain.argmax(1)
    return np.where(gain[each, best] > gain[each, own] + 1e-9, best, own)


def _move(table_: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, own: np.ndarray, best: np.ndarray) -> None:
    """Note in ``table_`` that words went from ``own`` to ``best``."""
    moved = np.flatnonzero(own != best)
    if len(moved):
        change = np.zeros((len(moved), len(table_)))
        each = np.arange(len(moved))
        change[each, best[moved]] += 1
        change[each, own[moved]] -= 1
        table_ += change.T @ after[moved] + before[moved].T @ change + np.diag(twice[moved] @ change)


def likelihood(table_: np.ndarray) -> float:
    """Of the class transitions, as far as classes can change it."""
    return float(_f(table_).sum() - _f(table_.sum(0)).sum() - _f(table_.sum(1)).sum())


def _whole_keys(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches sorted by their first column, put together so that no key is cut."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            found = pa.Table.from_batches(held)
            keys = found.column(0).to_numpy()
            ready = int(np.searchsorted(keys, keys[-1]))
            if ready:
                yield found.slice(0, ready)
                held, rows = found.slice(ready).to_batches(), rows - ready
    if rows:
        yield pa.Table.from_batches(held)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    """The numbers in all lists of a column."""
    return rows[name].combine_chunks().flatten().to_numpy()


def contexts(side_by_side: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row for each id: the ids ``near`` it and how often, ``n``, below zero
    for those before it. A row holds no more than two numbers for each id."""
    ids = vocabulary.end + 1

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches, 1):
            pair = _column(rows, "left").astype(np.int64) * ids + _column(rows, "right")
            order = np.argsort(pair)
            pair = pair[order]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            n = np.add.reduceat(_column(rows, "n")[order], first)
            u, v = np.divmod(pair[first], ids)
            key, near, n = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([n, -n])
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            lists = {"near": pa.array(near[order], pa.int32()), "n": pa.array(n[order])}
            yield _listed(starts, lists, pa.array(key[starts], pa.int32()), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Every pair lies in one part, so a key's lists have nothing in common.
        for rows in _whole_keys(batches, GROUPED_AT_ONCE):
            keys, near = rows["key"].to_numpy(), rows["near"].combine_chunks()
            starts = np.flatnonzero(np.diff(keys, prepend=-1))
            at = near.offsets.to_numpy()[starts] - near.offsets[0].as_py()
            lists = {"near": near.flatten(), "n": rows["n"].combine_chunks().flatten()}
            yield _listed(at, lists, pa.array(keys[starts]), "key")

    return (
        side_by_side.filter("n IS NOT NULL").select("part", "left", "right", "n")
        .repartition("part").sortWithinPartitions("part")
        .mapInArrow(added, "key INT, near ARRAY<INT>, n ARRAY<BIGINT>")
        .repartition("key").sortWithinPartitions("key")
        .mapInArrow(run, "key INT, near ARRAY<INT>, n ARRAY<BIGINT>")
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Keys, then for every number in their lists its row, ``near`` and ``n``."""
    near, n = batch.column(1), batch.column(2)
    sizes = np.diff(near.offsets.to_numpy())
    return (
        batch.column(0).to_numpy(), np.repeat(np.arange(len(sizes)), sizes),
        near.flatten().to_numpy(), n.flatten().to_numpy(),
    )


def class_table(found: DataFrame, member: np.ndarray, classes: int) -> np.ndarray:
    """How often an id of one class follows one of another; ids of no class,
    ``classes``, are left out."""

    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, row, near, n = _flat(batch)
        some = n > 0
        return member[keys[row[some]]] * (classes + 1) + member[near[some]], n[some]

    counted = _added_up(found, run, (classes + 1) ** 2)
    return counted.reshape(classes + 1, classes + 1)[:classes, :classes]


def exchange_ids(found: DataFrame, member: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Every id of ``found`` moves to its best class, in as many tasks as that has.
    A task sees its own moves, and the others as they were before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own_table, classes = member.copy(), table_.copy(), len(table_)
        for batch in slices(batches, MOVED_AT_ONCE):
            keys, row, near, n = _flat(batch)
            itself = near == keys[row]
            after, before = (
                np.bincount(row[s] * classes + now[near[s]], abs(n[s]), len(keys) * classes).reshape(-1, classes)
                for s in ((n > 0) & ~itself, (n < 0) & ~itself)
            )
            s = itself & (n > 0)
            twice = np.bincount(row[s], n[s], len(keys))
            own = now[keys]
            best = best_classes(own_table, after, before, twice, own)
            _move(own_table, after, before, twice, own, best)
            now[keys] = best
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(best, pa.int32())], names=["key", "class"])

    moved = found.mapInArrow(run, "key INT, class INT").toArrow()
    result = member.copy()
    result[moved.column("key").to_numpy()] = moved.column("class").to_numpy()
    return result


def exchange_others(side_by_side: DataFrame, vocabulary: Vocabulary, member: np.ndarray, table_: np.ndarray) -> DataFrame:
    """One pass over the words that are not in the vocabulary, from the classes of
    their endings, ``start``: ``key``, ``class`` and ``next``, the keys of the words
    after it that are not in the vocabulary either. Rows without a key hold in ``next``
    how often classes follow each other where one of both words is in the vocabulary."""
    classes, size, end = len(table_), vocabulary.size, vocabulary.end
    names = ["key", "start", "class", "next"]

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In the order of their keys, as the parts are."""
        for rows in _whole_keys(batches, 1):
            lists = [rows[name].combine_chunks().flatten() for name in ("key", "own", "left", "right", "next")]
            order = pa.array(np.argsort(lists[0].to_numpy(), kind="stable"))
            found = pa.Table.from_arrays([x.take(order) for x in lists], names=["key", "own", "left", "right", "next"])
            yield from found.to_batches(SORTED_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_table = table_.copy()
        cells = np.zeros(classes * classes, np.int64)
        for rows in _whole_keys(occurrences(batches), GROUPED_AT_ONCE):
            keys, ids, left, right = (rows.column(i).to_numpy() for i in range(4))
            follows = rows.column(4).combine_chunks()
            other = follows.is_valid().to_numpy(zero_copy_only=False)
            follows = follows.fill_null(0).to_numpy()
            first = np.append(True, keys[1:] != keys[:-1])
            starts, row = np.flatnonzero(first), np.cumsum(first) - 1
            own = member[ids[starts]]
            itself = other & (follows == keys)
            twice = np.bincount(row[itself], minlength=len(starts)).astype(float)
            after, before = (
                np.bincount(row * classes + member[x], minlength=len(starts) * classes).reshape(-1, classes).astype(float)
                for x in (right, left)
            )
            for x in (after, before):
                x[np.arange(len(own)), own] -= twice
            best = best_classes(own_table, after, before, twice, own)
            _move(own_table, after, before, twice, own, best)
            known = (left < size) | (left == end)
            cells += np.bincount(member[left[known]] * classes + best[row[known]], minlength=len(cells))
            cells += np.bincount(best[row[~other]] * classes + member[right[~other]], minlength=len(cells))
            offsets = np.append(0, np.cumsum(np.bincount(row[other], minlength=len(starts))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[starts]), pa.array(own, pa.int32()), pa.array(best, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(follows[other])),
                ],
                names=names,
            )
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()),
                pa.array([cells.tolist()], pa.list_(pa.int64())),
            ],
            names=names,
        )

    return (
        side_by_side.filter("key IS NOT NULL").select("part", "key", "own", "left", "right", "next")
        .repartition("part").sortWithinPartitions("part")
        .mapInArrow(run, "key BIGINT, start INT, class INT, next ARRAY<BIGINT>")
    )


def word_classes(training: DataFrame, vocabulary: Vocabulary, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Class of every id, how often classes follow each other, and ``key``,
    ``class`` of the words that are not in the vocabulary.

    Tasks do not see each other's moves. Moves of the vocabulary's words that do
    not raise the likelihood together are undone, and if none did, fewer words move
    at once in the next pass. The pass over the other words is undone if it does
    not raise the likelihood; their classes are then those of their endings.
    """
    spark = training.sparkSession
    # Far larger than the other steps, so they go as soon as they are read.
    large = [scratch_path(spark, label) for label in ("word-neighbours", "word-contexts")]
    side_by_side = stored(neighbours(training, vocabulary), "word-neighbours", large[0])
    found = stored(contexts(side_by_side, vocabulary), "word-contexts", large[1])
    pairs = class_table(found, vocabulary.item_of_id, ITEMS)
    member = exchange(pairs)
    one_hot = np.eye(CLASSES)[member]
    table_ = one_hot.T @ pairs @ one_hot
    member = member[vocabulary.item_of_id]
    parts = 1
    for _ in range(passes):
        raised = False
        for part in range(parts):
            moved = exchange_ids(found.filter(F.col("key") % parts == part), member, table_)
            if np.array_equal(moved, member):
                continue
            after = class_table(found, moved, CLASSES)
            if likelihood(after) > likelihood(table_):
                member, table_, raised = moved, after, True
        if not raised:
            parts *= FEWER_AT_ONCE
    others = stored(exchange_others(side_by_side, vocabulary, member, table_), "word-moves")
    own = others.filter("key IS NOT NULL").select("key", "class")

    def by_cell(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = batch.column(0).flatten().to_numpy()
        return np.arange(len(n)) % CLASSES**2, n

    cells = _added_up(others.filter("key IS NULL").select("next"), by_cell, CLASSES**2)
    adjacent = (
        others.filter("key IS NOT NULL").select(F.col("class").alias("u"), F.explode("next").alias("key"))
        .join(own, "key").select((F.col("u") * CLASSES + F.col("class")).alias("at"), F.lit(1).cast("long").alias("n"))
    )
    apart = member.copy()
    apart[vocabulary.size : vocabulary.end] = CLASSES
    after = class_table(found, apart, CLASSES).ravel() + cells
    for path in large:
        delete(spark, path)
    for row in adjacent.groupBy("at").agg(F.sum("n").alias("n")).collect():
        after[row["at"]] += row.n
    after = after.reshape(CLASSES, CLASSES)
    if likelihood(after) > likelihood(table_):
        return member, after, own
    return member, table_, others.filter("key IS NOT NULL").select("key", F.col("start").alias("class"))


class ClassModel:
    """Transitions between classes and words within them, all as log10.

    In a class the words seen and ``unseen``, the share of all others, add up to
    one; a word not seen has the part of that share that its spelling gives it.
    ``pairs`` and ``rare`` count by item, or by class if ``classes`` gives the
    class of each id.
    """

    def __init__(
        self, vocabulary: Vocabulary, pairs: np.ndarray, rare: tuple, ends: int, classes: np.ndarray | None = None
    ):
        rare_n, rare_v, once, twice = rare
        moves = pairs
        if classes is None:
            self.member = exchange(pairs)
            one_hot = np.eye(CLASSES)[self.member]
            moves, rare_n, rare_v = one_hot.T @ pairs @ one_hot, one_hot.T @ rare_n, one_hot.T @ rare_v
            classes = self.member[vocabulary.item_of_id]
        self.classes = classes
        share = (moves.sum(0) + 1) / (moves.sum() + CLASSES)
        self.moves = np.log10((moves + PRIOR * share) / (moves.sum(1, keepdims=True) + PRIOR))
        # Taken from every word but the first OWN_ITEMS, given to unseen words.
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        own, end = classes[: vocabulary.size], classes[vocabulary.end]
        self.mass = np.bincount(own[:OWN_ITEMS], vocabulary.counts[:OWN_ITEMS], CLASSES) + rare_n + UNSEEN
        self.mass[end] += ends
        self.unseen = np.log10((self.discount * rare_v + UNSEEN) / self.mass)
        less = np.where(np.arange(vocabulary.size) < OWN_ITEMS, 0, self.discount)
        self.words = np.log10((vocabulary.counts - less) / self.mass[own])
        self.end = math.log10(ends / self.mass[end]) if ends else float(self.unseen[end])


def class_totals(counts: DataFrame, others: DataFrame, vocabulary: Vocabulary, classes: np.ndarray) -> tuple:
    """As ``rare_totals``, by class: ``others`` has the words that are not in the
    vocabulary, ``classes`` the class of each id."""
    own = classes[OWN_ITEMS : vocabulary.size] if vocabulary.size > OWN_ITEMS else classes[:0]
    n = np.bincount(own, vocabulary.counts[OWN_ITEMS:], CLASSES)
    v = np.bincount(own, minlength=CLASSES).astype(float)
    for row in others.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[row["class"]] += row.n
        v[row["class"]] += row.v
    once, twice = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    return n, v, once, twice


_RARE = "ARRAY<STRUCT<word: BINARY, class: INT, n: BIGINT, spelling: DOUBLE>>"


def score_texts(
    docs: DataFrame, vocabulary: Vocabulary, model: ClassModel, letters: np.ndarray, n: int, v: int, ends: int
) -> DataFrame:
    """``doc_id``, ``held_out`` and the sums that need no other words, plus
    ``rare``, the words still to be looked up with number and the class of their
    ending, and ``left`` and ``right``, the classes of all steps from or to these
    words; -1 stands for the first of ``rare``, -2 for the second."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bottom = n + ADDED * (v + 1)
    base_words = np.log10((vocabulary.counts + ADDED) / bottom)
    base_end = math.log10((ends + ADDED) / bottom)
    size, end = vocabulary.size, model.classes[[vocabulary.end]]

    def listed(sizes: list[int], values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sums: list[tuple] = []
            steps: list[list[np.ndarray]] = [[], []]
            rare_words, rare_ids, rare_n, sizes = [], [], [], []
            for data in as_bytes(batch.column(2)):
                words = words_of(data)
                ids, others = vocabulary.ids_of(words)
                number: dict[bytes, int] = {}
                at = np.array([number.setdefault(words[i], len(number)) for i in others.tolist()], np.int64)
                line = np.concatenate([end, model.classes[ids], end])
                line[others + 1] = -1 - at
                left, right = line[:-1], line[1:]
                late = (left < 0) | (right < 0)
                known = ids[ids < size]
                sums.append((
                    len(words) + 1,
                    len(known) + (ends > 0),
                    float(base_words[known].sum()) + base_end,
                    float(model.words[known].sum() + model.moves[left[~late], right[~late]].sum()) + model.end,
                ))
                for some, side in zip(steps, (left, right), strict=True):
                    some.append(side[late].astype(np.int32))
                first = np.zeros(len(number), np.int64)
                first[at[::-1]] = others[::-1]
                rare_words += number
                rare_ids.append(ids[first])
                rare_n.append(np.bincount(at, minlength=len(number)))
                sizes.append(len(number))
            rare = pa.StructArray.from_arrays(
                [
                    pa.array(rare_words, pa.binary()),
                    pa.array(model.classes[np.concatenate(rare_ids)], pa.int32()),
                    pa.array(np.concatenate(rare_n), pa.int64()),
                    pa.array(spell(rare_words, letters), pa.float64()),
                ],
                names=["word", "class", "n", "spelling"],
            )
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    *[pa.array(c, k) for c, k in zip(zip(*sums, strict=True), kinds, strict=True)],
                    listed(sizes, rare),
                    *[listed([len(x) for x in some], pa.array(np.concatenate(some))) for some in steps],
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "left", "right"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run,
        f"doc_id {kind}, held_out BOOLEAN, n_tokens BIGINT, n_known BIGINT, base DOUBLE, "
        f"model DOUBLE, rare {_RARE}, left ARRAY<INT>, right ARRAY<INT>",
    )


def add_late_steps(scored: DataFrame, moves: np.ndarray) -> DataFrame:
    """Adds to ``score`` the steps ``left``, ``right`` from and to words whose
    classes ``found`` tells."""
    names = [c for c in scored.columns if c not in ("left", "right", "found")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            found = columns["found"]
            sizes = found.value_lengths().fill_null(0).to_numpy()
            offsets = np.cumsum(sizes) - sizes
            told = found.flatten()
            classes = np.empty(len(told), np.int64)
            at = told.field("at").to_numpy() + np.repeat(offsets, sizes)
            classes[at] = told.field("class").to_numpy()
            row = np.repeat(np.arange(len(sizes)), columns["left"].value_lengths().to_numpy())
            sides = []
            for name in ("left", "right"):
                side = columns[name].flatten().to_numpy().astype(np.int64)
                late = np.flatnonzero(side < 0)
                side[late] = classes[offsets[row[late]] - 1 - side[late]]
                sides.append(side)
            late = np.bincount(row, moves[sides[0], sides[1]], len(sizes))
            columns["score"] = pa.array(columns["score"].to_numpy() + late)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return scored.mapInArrow(run, kinds)


def score_documents(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """Base and model score of every row of ``docs`` (doc_id, text, held_out),
    learned from the rows not held out.

    NULL and empty texts have one token, the end. Words beyond the broadcast
    vocabulary are joined with the table of all counts and classes; the frequent
    ones never enter that shuffle, so it has no hot key.
    """
    training = docs.filter(~F.col("held_out"))
    counts = stored(count_words(training), "word-counts")
    occurrences, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("word")).first()
    ends = training.count()
    n, v = occurrences + ends, distinct + (ends > 0)
    vocabulary = Vocabulary(most_frequent(counts, distinct))
    classes, moves, own = word_classes(training, vocabulary, passes)
    # The vocabulary holds every word of at least its least count.
    beyond = counts.filter(F.col("c") < int(vocabulary.counts.min())) if vocabulary.size else counts
    others = stored(
        beyond.withColumn("key", F.xxhash64("word")).join(own, "key").select("word", "c", "class"), "word-classes"
    )
    model = ClassModel(vocabulary, moves, class_totals(counts, others, vocabulary, classes), ends, classes)
    scored = stored(
        score_texts(docs, vocabulary, model, spelling(counts), n, v, ends).withColumn("row", F.monotonically_increasing_id()),
        "word-scores",
    )
    mass = F.array(*[F.lit(float(x)) for x in model.mass])
    unseen = F.array(*[F.lit(float(x)) for x in model.unseen])
    seen = F.col("c").isNotNull()
    rare = scored.select("row", F.posexplode("rare").alias("at", "r")).select(
        "row", "at", "r.word", F.col("r.class").alias("by_ending"), "r.n", "r.spelling"
    )
    kind = F.coalesce("class", "by_ending")
    looked_up = (
        rare.join(others, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(
                F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + ADDED) / (n + ADDED * (v + 1)))
            ).alias("more_base"),
            F.sum(
                F.col("n")
                * F.when(seen, F.log10((F.col("c") - model.discount) / mass[kind])).otherwise(
                    unseen[kind] + F.col("spelling")
                )
            ).alias("more_model"),
            F.collect_list(F.struct("at", kind.alias("class"))).alias("found"),
        )
    )
    zero = F.lit(0)
    known = scored.drop("rare").join(looked_up, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero)).alias("score"),
        "left",
        "right",
        "found",
    )
    return add_late_steps(known, model.moves).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; a NULL doc_id is held out."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", whole_text().alias("text"), (remainder(F.col("doc_id"), 10) == 0).alias("held_out")
    )
    return score_documents(docs)
