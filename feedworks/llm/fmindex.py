"""An FM-index over a delimited vocabulary, and search with one error.

The words stand between delimiters, ``$word$word$``. A pattern is read from its
end to its start; the rows of the suffix array that begin with what was read are
an interval, and reading one more symbol is a rank query at both of its ends.
Ranks come from a bit for each symbol and row, in blocks of 64 rows with the
counts before each. Extension to the right is extension to the left in the index
of the reversed words, so two such indexes are the two directions.
"""

from __future__ import annotations

import numpy as np

END = 0


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``$word$word$`` with END as ``$``, the place of each word's
    first symbol, and its length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths
    text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), "<u4")
    return text, starts, lengths


def suffix_array(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Places of all suffixes in order: as many symbols as fit one integer are
    sorted at once, then ranks are doubled until no two are equal."""
    size = len(codes)
    bits = max(1, int(symbols).bit_length())
    span = 62 // bits
    key = np.zeros(size, np.int64)
    for k in range(span):
        # Past the end is less than any symbol.
        key <<= bits
        if k < size:
            key[: size - k] += codes[k:].astype(np.int64) + 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        if rank[order[-1]] == size - 1:
            return order
        key = rank * (size + 1)
        if span < size:
            key[: size - span] += rank[span:] + 1
        span *= 2


class Index:
    """The index of distinct words, whose numbers are their places in ``words``."""

    def __init__(self, words: list[str]) -> None:
        text, self.starts, _ = flat(words)
        self.alphabet, codes = np.unique(text, return_inverse=True)
        codes = codes.reshape(-1)
        self.sigma = len(self.alphabet)
        self.rows = len(codes)
        self.suffixes = suffix_array(codes, self.sigma)
        before = codes[self.suffixes - 1]
        row = np.arange(self.rows)
        blocks = (self.rows >> 6) + 1
        self.marks = np.zeros((blocks, self.sigma), np.uint64)
        np.add.at(self.marks, (row >> 6, before), np.uint64(1) << (row & 63).astype(np.uint64))
        counts = np.bitwise_count(self.marks).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=self.sigma))))[:-1]
        # Where a symbol's rows begin, plus how often it came in earlier blocks.
        self.base = np.cumsum(counts, axis=0) - counts + first

    def coded(self, text: np.ndarray) -> np.ndarray:
        """Symbols as numbers of this index's alphabet, -1 for others."""
        at = np.minimum(np.searchsorted(self.alphabet, text), self.sigma - 1)
        return np.where(self.alphabet[at] == text, at, -1)

    def _below(self, rows: np.ndarray) -> np.ndarray:
        return (np.uint64(1) << (rows & 63).astype(np.uint64)) - np.uint64(1)

    def step(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """One end of each interval after one more symbol."""
        block = rows >> 6
        inside = self.marks[block, symbols] & self._below(rows)
        return self.base[block, symbols] + np.bitwise_count(inside)

    def steps(self, rows: np.ndarray) -> np.ndarray:
        """The same for every symbol of the alphabet."""
        block = rows >> 6
        inside = self.marks[block] & self._below(rows)[:, None]
        return self.base[block] + np.bitwise_count(inside)

    def word_at(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the words whose leading delimiter is at these rows."""
        return np.searchsorted(self.starts, self.suffixes[rows] + 1)


def near_words(
    index: Index, queries: list[str], exact: np.ndarray, change: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's number and a word's: the last ``exact`` symbols of the
    query end the word, and the rest differs by one symbol, replaced (``change``
    0), inserted (1) or deleted (-1). No pair twice."""
    text, starts, lengths = flat(queries)
    codes = index.coded(text)
    query = np.arange(len(queries))
    place = starts + lengths
    low = np.zeros(len(queries), np.int64)
    high = np.full(len(queries), index.rows)
    turn = starts + lengths - exact

    def read(query, place, low, high):
        """Read the symbol at ``place``; states without rows end."""
        symbol = codes[place]
        known = symbol >= 0
        query, place, low, high, symbol = query[known], place[known], low[known], high[known], symbol[known]
        low, high = index.step(low, symbol), index.step(high, symbol)
        alive = low < high
        return query[alive], place[alive] - 1, low[alive], high[alive]

    # The half without error, closing delimiter first.
    waiting = []
    while len(query):
        ready = place < turn[query]
        waiting.append((query[ready], place[ready], low[ready], high[ready]))
        query, place, low, high = read(query[~ready], place[~ready], low[~ready], high[~ready])
    query, place, low, high = map(np.concatenate, zip(*waiting, strict=True)) if waiting else (query, place, low, high)

    # The other half: an error at every place, beside going on without one.
    erred = []
    while len(query):
        inside, kind = place >= starts[query], change[query]
        lacks = inside & (kind < 0)
        erred.append((query[lacks], place[lacks] - 1, low[lacks], high[lacks]))
        fits = np.flatnonzero((kind > 0) | inside & (kind == 0))
        lows, highs = index.steps(low[fits]), index.steps(high[fits])
        there = lows < highs
        there[:, END] = False
        # A symbol in place of the query's own is another one.
        replaced = kind[fits] == 0
        own = np.where(replaced, codes[place[fits]], END)
        there[np.arange(len(fits)), np.maximum(own, END)] = False
        at, symbol = np.nonzero(there)
        erred.append((query[fits[at]], place[fits[at]] - replaced[at], lows[at, symbol], highs[at, symbol]))
        query, place, low, high = read(query[inside], place[inside], low[inside], high[inside])

    # What is left of the query, opening delimiter last.
    query, place, low, high = map(np.concatenate, zip(*erred, strict=True)) if erred else (query, place, low, high)
    found = [np.empty(0, np.int64)]
    words = len(index.starts)
    while len(query):
        query, place, low, high = read(query, place, low, high)
        over = place < starts[query] - 1
        found.append(query[over] * words + index.word_at(low[over]))
        query, place, low, high = query[~over], place[~over], low[~over], high[~over]
    pairs = np.unique(np.concatenate(found))
    return pairs // words, pairs % words
