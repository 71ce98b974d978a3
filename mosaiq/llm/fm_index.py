"""A compressed FM-index over integer symbols: wavelet matrix, backward search, matching statistics.

Suffixes are sorted by their first symbols only, as deep as the search needs (twice the power of two at or
below the threshold); backward search is exact for patterns up to that depth. Bits are packed in 64-bit
words with a count for each word. All searches run side by side over many patterns.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class BitVector:
    """Packed bits with rank support."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        self.width = max(1, int(top).bit_length())
        for shift in range(self.width - 1, -1, -1):
            bit = (values >> shift) & 1
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.base = self._place(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (self.width - 1 - level)) & 1).astype(bool)
            ones = bits.ones(i)
            i = np.where(one, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position i."""
        return self._place(symbol, i) - self.base[symbol]


class FMIndex:
    """Index of texts given as runs of symbols from 1 on, with a 0 behind each run.

    ``threshold`` is the length of the matches that are looked for: matching statistics are told up to it.
    """

    def __init__(self, text: np.ndarray, threshold: int):
        n = len(text)
        self.threshold, self.size = threshold, n
        rank, ranks, depth = text.astype(np.int64), {}, 1
        while True:
            ranks[depth] = rank
            if depth > threshold:
                break
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - depth)] = rank[depth:] + 1
            key = rank * (n + 2) + behind
            order = np.argsort(key)
            step = np.concatenate(([0], np.diff(key[order]) != 0)).cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = step
            depth *= 2
        self.text = text.astype(np.int32)
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        self.top = int(text.max())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.top + 1))))
        self.bwt = WaveletMatrix(text[self.suffixes - 1], self.top)
        common = self._common(ranks)
        self.parent_of, self.parent_start = self._classes(common, threshold - 1)
        self.match_of, self.match_start = self._classes(common, threshold)
        # Smallest common lengths of 1, 2, 4, ... neighbours in a row, which lead to the ends of a range.
        self.least_common = [common]
        while (width := 1 << len(self.least_common)) <= n:
            last = self.least_common[-1]
            self.least_common.append(np.minimum(last[: n + 2 - width], last[width // 2 :]))

    def _common(self, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """Symbols that each sorted suffix shares with the one before it, up to the threshold; 0 at both ends."""
        left, right = self.suffixes[:-1].astype(np.int64), self.suffixes[1:].astype(np.int64)
        shared = np.zeros(len(left), np.int64)
        for depth in sorted(ranks, reverse=True):
            rank = ranks[depth]
            a, z = left + shared, right + shared
            inside = (a < self.size) & (z < self.size)
            shared += depth * (inside & (rank[np.minimum(a, self.size - 1)] == rank[np.minimum(z, self.size - 1)]))
        return np.concatenate(([0], np.minimum(shared, self.threshold), [0])).astype(np.int32)

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """For each class of equal windows, the smallest of its places' values."""
        return np.minimum.reduceat(values[self.suffixes], self.match_start[:-1])

    def classes_at(self, places: np.ndarray) -> np.ndarray:
        """The classes of the indexed windows that start at these places of the text."""
        class_of = np.empty(self.size, np.int64)
        class_of[self.suffixes] = self.match_of
        return class_of[places]

    def _classes(self, common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of sorted suffixes that share their first ``depth`` symbols: the run of each, and the runs' starts."""
        if depth == 0:
            return np.zeros(self.size, np.int64), np.array([0, self.size])
        start = np.flatnonzero(common[:-1] < depth)
        return np.repeat(np.arange(len(start)), np.diff(np.r_[start, self.size])), np.r_[start, self.size]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the ranges of the patterns with a symbol put in front."""
        n = len(symbol)
        rank = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return self.first[symbol] + rank[:n], self.first[symbol] + rank[n:]

    def shorten(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of matches of the threshold's length without their last symbol."""
        run = self.parent_of[lo]
        return self.parent_start[run], self.parent_start[run + 1]

    def around(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of sorted suffixes that share their first ``depth`` symbols with the one at each place."""
        lo, hi = at.copy(), at + 1
        for k in range(len(self.least_common) - 1, -1, -1):
            least, width = self.least_common[k], 1 << k
            start = lo - width + 1
            lo = np.where((start >= 0) & (least[np.maximum(start, 0)] >= depth), lo - width, lo)
            hi = np.where((hi < len(least)) & (least[np.minimum(hi, len(least) - 1)] >= depth), hi + width, hi)
        return lo, hi

    def matches(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ranges of every window of the threshold's length in text[begin:end] of each pattern.

        Goes through the patterns from their ends: the longest match at a place is reached by one backward step
        from that of the place behind it, shortened by one symbol if it has the threshold's length, or to the
        longest one that goes on (``_longest``) if it breaks off. Gives, for each step, (pattern, window's offset
        in the pattern, class of equal windows, -1 if the window doesn't occur).
        """
        w, out = self.threshold, []
        order = np.argsort(begin - end, kind="stable")  # longest first: those still going are a prefix
        begin, end = begin[order], end[order]
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.size)
        length = np.zeros(len(order), np.int64)
        for step in range(int((end - begin).max()) if len(order) else 0):
            going = int(np.searchsorted(-(end - begin), -step, side="left"))
            at = end[:going] - 1 - step
            full = length[:going] == w
            if full.any():
                a, z = self.shorten(lo[:going][full])
                lo[:going][full], hi[:going][full] = a, z
                length[:going][full] -= 1
            symbol = text[at]
            known = (symbol > 0) & (symbol <= self.top)
            a, z = self.extend(np.where(known, symbol, 0), lo[:going], hi[:going])
            size = length[:going] + 1
            if (broken := known & (a >= z)).any():
                a[broken], z[broken], size[broken] = self._longest(text, at[broken], a[broken], size[broken])
            lo[:going], hi[:going] = np.where(known, a, 0), np.where(known, z, self.size)
            length[:going] = np.where(known, size, 0)
            wide = end[:going] - at >= w
            if wide.any():
                hit = length[:going] == w
                out.append((order[:going][wide], (at - begin[:going])[wide], np.where(hit, self.match_of[np.minimum(lo[:going], self.size - 1)], -1)[wide]))
        return out

    def _longest(self, text: np.ndarray, at: np.ndarray, place: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ranges and lengths of the longest prefixes of text[at:], of less than ``most`` symbols, that occur.

        place: where text[at:at + most] would stand among the sorted suffixes. What shares most with it is there or
        just before.
        """
        best, size = place, np.full(len(at), -1)
        for beside in (place - 1, place):
            inside = (beside >= 0) & (beside < self.size)
            there = self.suffixes[np.clip(beside, 0, self.size - 1)].astype(np.int64)
            same, shared = inside.copy(), np.zeros(len(at), np.int64)
            for k in range(int(most.max())):
                same &= k < most
                same[same] = self.text[np.minimum(there[same] + k, self.size - 1)] == text[at[same] + k]
                if not same.any():
                    break
                shared += same
            best, size = np.where(shared > size, beside, best), np.maximum(shared, size)
        lo, hi = self.around(best, size)
        nothing = size == 0
        return np.where(nothing, 0, lo), np.where(nothing, self.size, hi), size
