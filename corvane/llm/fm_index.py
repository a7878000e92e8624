"""An FM-index over sequences of words: suffix array by doubling, a wavelet matrix of packed bits, backward search in bulk."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling the compared length until all differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        key = rank[order] * (n + 1) + second[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = np.cumsum(key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Over sequences of 64-bit words; a match never crosses from one sequence into the next.

    Each level of the wavelet matrix keeps one bit a symbol and a count for every 64: about 1.5 bits a symbol and level.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, weights: np.ndarray):
        """``words``: all sequences end to end; ``ends``: where each ends; ``weights``: how often each counts."""
        self.alphabet, codes = np.unique(words, return_inverse=True)
        self.texts = codes + 1  # the sequences in the index's own symbols
        n = len(words) + len(ends)
        gaps = ends + np.arange(len(ends))
        mark = np.zeros(n, bool)
        mark[gaps] = True
        symbols = np.empty(n, np.int64)
        symbols[mark] = np.arange(len(ends))  # each separator sorts apart, so doubling ends with the longest sequence
        symbols[~mark] = codes + len(ends)
        order = suffix_array(symbols)
        each = np.repeat(weights, np.diff(np.concatenate(([0], ends))) + 1)
        self.weight = np.concatenate(([0], np.cumsum(each[order])))  # of the suffixes before each place in order
        plain = np.where(symbols < len(ends), 0, symbols - len(ends) + 1)
        last = plain[order - 1]  # the symbol before each suffix
        counts = np.bincount(plain, minlength=len(self.alphabet) + 1)
        self.smaller = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.n, self.bits = n, max(1, int(len(self.alphabet)).bit_length())
        self.levels = []
        for k in range(self.bits - 1, -1, -1):
            bit = (last >> k) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)))[:-1].astype(np.int32)
            zeros = n - int(bit.sum())
            self.levels.append((packed, before, zeros))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        self.origin = self._down(np.arange(len(self.alphabet) + 1), np.zeros(len(self.alphabet) + 1, np.int64))

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (packed, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            block = at >> 6
            ones = before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((code >> k) & 1 == 1, zeros + ones, at - ones)
        return at

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, each extended to the left by one symbol."""
        at = self._down(np.concatenate((code, code)), np.concatenate((low, high))) - np.concatenate((self.origin[code], self.origin[code])) + np.concatenate((self.smaller[code], self.smaller[code]))
        return at[: len(code)], at[len(code) :]


def repeated_windows(index: FMIndex, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """For each place in ``codes``, whether the window that begins there occurs in the index with weight 2 or more.

    That is, where the matching statistic reaches ``window``. Sequences (``begins``, ``sizes``), in the index's symbols, are streamed side by side: each tests a stretch from its cursor by backward search
    from the stretch's end, one word a round. A stretch that reaches the cursor clears all its windows and the next is
    longer. A longer one that fails is halved; where a bare window fails at some place, no window with that place and the
    window's end can occur twice, so the cursor moves past it.
    """
    found = np.zeros(len(codes), bool)
    last = sizes - window  # of the windows' numbers
    who = np.flatnonzero(last >= 0)
    cursor, extra = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    at = cursor[who] + window  # the stretch from here to its end is matched so far
    low, high = np.zeros(len(who), np.int64), np.full(len(who), index.n, np.int64)
    while len(who):
        at = at - 1
        low, high = index.extend(codes[begins[who] + at], low, high)
        failed = index.weight[high] - index.weight[low] < 2
        reached = ~failed & (at == cursor[who])
        if not (failed | reached).any():
            continue
        done = who[reached]
        for d in range(int(extra[done].max(initial=-1)) + 1):
            some = done[extra[done] >= d]
            found[begins[some] + cursor[some] + d] = True
        cursor[done] += extra[done] + 1
        extra[done] = 2 * extra[done] + 1
        bare = failed & (extra[who] == 0)
        cursor[who[bare]] = at[bare] + 1
        halved = failed & ~bare
        extra[who[halved]] //= 2
        again = failed | reached
        extra[who[again]] = np.minimum(extra[who[again]], np.maximum(0, last[who[again]] - cursor[who[again]]))
        at[again] = cursor[who[again]] + window + extra[who[again]]
        low[again], high[again] = 0, index.n
        left = cursor[who] <= last[who]
        who, at, low, high = who[left], at[left], low[left], high[left]
    return found
