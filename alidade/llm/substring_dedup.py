"""Substring dedup: words of a long passage that starts in a text with a smaller id too are removed.

Texts meet in shards of spans (see repeats). Each shard has an FM-index over its spans' words: a suffix array gives the
Burrows-Wheeler transform, which a wavelet tree holds in packed bits with a count every 64 bits. The spans are streamed
through it: backward search goes left from every place at once, one word a step, for as long as what it has read stands at
another place too. So each place gets its matching statistic, the length of the longest such match that
ends there, counted up to the threshold, and the least owner of what is found; places whose match has a smaller id report their window.

Defined results: a null or empty text has 0 words; windows do not cross texts; windows are judged on the input; of texts
that share a passage those with the smallest id keep it, all rows with that id; a row without an id neither loses
nor takes anything; very long texts are read in segments; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from alidade.llm.repeats import Unit, remove_repeats
from alidade.llm.words import word_hashes, word_spans


class BitRank:
    """Packed bits with a running count every 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletTree:
    """A wavelet tree with its levels laid out side by side, the highest bit first."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.levels = []
        now = symbols
        for level in range(self.depth):
            bits = (now >> (self.depth - 1 - level)) & 1
            self.levels.append(BitRank(bits))
            now = np.concatenate([now[bits == 0], now[bits == 1]])
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.ones(at)
            right = (symbol >> (self.depth - 1 - level)) & 1
            at = np.where(right == 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.start[symbol]


class LeastRange:
    """The least value of any range: of blocks of 16 values the least of ranges whose lengths are powers of two, and within a block by looking."""

    def __init__(self, values: np.ndarray, block: int = 16) -> None:
        self.block = block
        self.none = np.iinfo(values.dtype).max
        self.values = np.concatenate([values, np.full(-len(values) % block + block, self.none, values.dtype)])
        self.rows = [self.values.reshape(-1, block).min(axis=1)]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            row, reach = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(row[:-reach], row[reach:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over low to high - 1, which is not empty."""
        first, last = -(-low // self.block), high // self.block  # whole blocks
        out = np.full(len(low), self.none, self.values.dtype)
        wide = np.flatnonzero(last > first)
        level = np.frexp((last - first)[wide].astype(float))[1] - 1
        for k in np.unique(level).tolist():
            some = wide[level == k]
            out[some] = np.minimum(self.rows[k][first[some]], self.rows[k][last[some] - (1 << k)])
        left, right = np.minimum(first * self.block, high), np.maximum(last * self.block, low)
        for a, z in ((low, left), (np.maximum(right, left), high)):
            for k in range(int((z - a).max(initial=0))):
                out = np.where(a + k < z, np.minimum(out, self.values[np.minimum(a + k, len(self.values) - 1)]), out)
        return out


class FMIndex:
    """Full-text index of words from 1 to size - 1; patterns of up to `longest` words can be searched. owner: the rank of each place's owner."""

    def __init__(self, symbols: np.ndarray, size: int, longest: int, owner: np.ndarray) -> None:
        order = context_order(symbols, longest)
        self.counts = np.bincount(symbols, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        self.tree = WaveletTree(symbols[order - 1], size)  # of suffix 0 the last symbol, a separator
        self.least = LeastRange(owner[order])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the patterns that begin with the symbols and go on as those of rows low to high - 1."""
        return self.first[symbol] + self.tree.rank(symbol, low), self.first[symbol] + self.tree.rank(symbol, high)

    def matching_statistics(self, symbols: np.ndarray, ends_at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the indexed symbols the length, up to `most`, of the longest match that ends there and stands at another place too, and the least owner.

        The search for a place ends at `most` words, or where its match has one row left: that is the place itself, and stays the only
        one however far the search goes left. The least owner is the least rank among those of the rows that are left, so of whoever has the `most` words.
        """
        low = self.first[symbols[ends_at]]
        high = low + self.counts[symbols[ends_at]]
        length = np.zeros(len(ends_at), np.int64)
        live = np.flatnonzero(high - low > 1)
        while len(live):
            length[live] += 1
            live = live[length[live] < most]
            low[live], high[live] = self.extend(symbols[ends_at[live] - length[live]], low[live], high[live])
            live = live[high[live] - low[live] > 1]
        least = self.least.values[low]
        found = np.flatnonzero(length >= most)
        least[found] = self.least.least(low[found], high[found])
        return length, least


def context_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in the order of their first `longest` symbols or more, by doubling."""
    n, done = len(symbols), 1
    rank = symbols.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while done < longest:
        after = np.zeros(n, np.int64)
        after[: max(n - done, 0)] = rank[done:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        new[:1] = 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        done *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def earlier_windows(contents: list[bytes], owners: list, window: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each span, whose smallest id is owners[k], the limits of the words that windows cover which stand in a text with a smaller id.

    First for the texts with the smallest id, and then for those with later ids, of which the owners are known to be smaller.
    """
    data = np.frombuffer(b"".join(contents), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    known, number = np.unique(hashes, return_inverse=True)
    counts = np.diff(first)
    # A separator, 0, after each span.
    stops = first[1:]
    symbols = np.insert(number.astype(np.int64) + 1, stops, 0)
    span = np.repeat(np.arange(len(contents)), counts + 1)
    begin = first[:-1] + np.arange(len(contents))
    rank_of = {m: k for k, m in enumerate(sorted(set(owners)))}
    owner = np.array([rank_of[m] for m in owners], np.int32)
    index = FMIndex(symbols, len(known) + 1, window, owner[span])
    inside = np.arange(len(symbols)) - begin[span]
    ends_at = np.flatnonzero((symbols > 0) & (inside >= window - 1))  # the last word of each window
    least = index.matching_statistics(symbols, ends_at, window)[1]
    out = []
    for below in (owner, owner + 1):  # a match counts if its owner's rank is less
        hit = ends_at[least < below[span[ends_at]]]
        change = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(change, hit - window + 1, 1)
        np.add.at(change, hit + 1, -1)
        covered = np.cumsum(change[:-1]) > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        up, down = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = span[up]  # a separator is never covered, so runs stay within their span
        both = np.stack([up - begin[of], down - begin[of]], axis=1)
        out.append([x.ravel().tolist() for x in np.split(both, np.searchsorted(of, np.arange(1, len(contents))))])
    return out[0], out[1]


def remove_earlier_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8) -> DataFrame:
    """Return id_col, n_words, n_removed, n_spans and kept (the words that stay, joined by one space, as UTF-8 bytes) for every row."""

    def solve(contents: list[bytes], _: list[int], owners: list) -> tuple[list[list[int]], list[list[int]]]:
        return earlier_windows(contents, owners, window)

    return remove_repeats(docs, id_col, text_col, Unit(True, window, gram), solve, earlier=True).toDF(id_col, "n_words", "n_removed", "n_spans", "kept")
