"""Run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

The index is built over several byte strings, each closed by a terminator of its own, so no match
crosses strings. Of the suffix array only the entries at the ends of the transform's runs are kept,
with the length of the match to the neighbour beyond that end. Streaming over the text then yields
every position's longest match elsewhere: inside a run the predecessor's (or successor's) match of
position i is that of i-1 less one byte, so each value is the nearest sample to the left less the
distance. That is the same step by which run-length indexes walk from one occurrence to the next.
"""

from __future__ import annotations

import numpy as np

from weftwise.llm.common import RollingHash

#: Symbols of 9 bits that a 63-bit key holds.
PACK = 7


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of strings laid end to end, ``ends`` being where each one stops (exclusive).

    Every string's end sorts as a distinct symbol below all bytes. Prefix doubling: each round sorts
    only the positions that are not yet alone with their prefix.
    """
    n = len(data)
    lengths = np.diff(ends, prepend=0)
    which = np.repeat(np.arange(len(ends), dtype=np.int64), lengths)
    left = ends[which] - np.arange(n, dtype=np.int64)
    key = np.zeros(n, np.int64)
    padded = np.zeros(n + PACK, np.int64)
    padded[:n] = data
    padded[:n] += 1
    for j in range(PACK):
        symbol = padded[j : j + n].copy()
        symbol[left <= j] = 0
        key = (key << 9) | symbol
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    cut = np.flatnonzero(left[order] < PACK)
    # positions that see their end within the key are told apart by the end's number; stable order has it
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    new[cut] = True
    after = cut + 1
    new[after[after < n]] = True
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = order[np.repeat(size > 1, size)]
    h = PACK
    sa = order
    while len(active):
        old = rank[active]
        # the next h symbols' rank; a string that stops right there is told apart by its terminator
        second = np.where(left[active] == h, which[active], rank[np.minimum(active + h, n - 1)] + len(ends))
        o = np.argsort(old * np.int64(n + len(ends)) + second)
        active, old, second = active[o], old[o], second[o]
        m = len(active)
        old_head = np.empty(m, bool)
        old_head[0] = True
        old_head[1:] = old[1:] != old[:-1]
        new_head = old_head.copy()
        new_head[1:] |= second[1:] != second[:-1]
        at = np.arange(m)
        first = np.maximum.accumulate(np.where(old_head, at, 0))
        own = np.maximum.accumulate(np.where(new_head, at, 0))
        rank[active] = old + (own - first)
        sa[old + (at - first)] = active
        size = np.diff(np.append(np.flatnonzero(new_head), m))
        active = active[np.repeat(size > 1, size)]
        h *= 2
    return sa


class RunLengthIndex:
    """Runs of the transform with their sampled ends; see the module's text.

    Matches shorter than ``least`` may read as shorter still: their samples are stored as 0.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, least: int = 1):
        n = len(data)
        self.n = n
        self.least = least
        sa = suffix_array(data, ends)
        # the symbol before each suffix; before a string's start stands a terminator, unlike any other
        before = np.empty(n, np.int64)
        before[1:] = data[:-1]
        starts = np.append(0, ends[:-1])
        starts = starts[starts < ends]
        before[starts] = 256 + np.arange(len(starts))
        bwt = before[sa]
        head = np.empty(n, bool)
        head[0] = True
        head[1:] = bwt[1:] != bwt[:-1]
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], n) - 1
        self.run_symbol, self.run_length = bwt[heads], np.diff(np.append(heads, n))
        lengths = np.diff(ends, prepend=0)
        left = np.repeat(ends, lengths) - np.arange(n)
        hashes = RollingHash(data)
        self.head_at, self.head_match = self._sampled(hashes, left, sa[heads], sa[np.maximum(heads - 1, 0)], heads > 0)
        self.tail_at, self.tail_match = self._sampled(hashes, left, sa[tails], sa[np.minimum(tails + 1, n - 1)], tails < n - 1)

    def _sampled(self, hashes: RollingHash, left: np.ndarray, at: np.ndarray, other: np.ndarray, real: np.ndarray):
        """Sampled positions in text order, with the length that each has in common with its neighbour."""
        low, high = np.zeros(len(at), np.int64), np.where(real, np.minimum(left[at], left[other]), 0)
        high[high < self.least] = 0
        some = np.flatnonzero(high)
        same = hashes.of(at[some], at[some] + self.least) == hashes.of(other[some], other[some] + self.least)
        low[some[same]] = self.least
        high[some[~same]] = 0
        while (open_ := np.flatnonzero(low < high)).size:
            p, q = at[open_], other[open_]
            middle = (low[open_] + high[open_] + 1) >> 1
            same = hashes.of(p, p + middle) == hashes.of(q, q + middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)
        o = np.argsort(at)
        return at[o], low[o]

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest string that starts there and also elsewhere in the index."""
        at = np.arange(self.n)

        def stream(where: np.ndarray, match: np.ndarray) -> np.ndarray:
            value = np.full(self.n, np.iinfo(np.int64).min // 2)
            value[where] = match + where
            return np.repeat(value[where], np.diff(np.append(where, self.n))) - at

        return np.maximum(stream(self.head_at, self.head_match), stream(self.tail_at, self.tail_match))
