"""An FM-index over a shard of word sequences: wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

from arbolith.llm.suffixes import suffix_array


class WaveletRanks:
    """How often each symbol occurs before a place of a sequence, by one bit of the symbol a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place at[i]."""
        begin, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            b, e = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + b, begin - b), np.where(bit, zeros + e, end - e)
        return end - begin


class FMIndex:
    """Index of `text`: positive word ids, with 0 after each sequence (and at the end).

    Every 16th position of a sequence is sampled, and its first one, so a walk back from any
    row ends within 16 steps and never crosses a 0.
    """

    STEP = 16

    def __init__(self, text: np.ndarray, words: int):
        self.size, bits = len(text), max(1, int(words).bit_length())
        ends = np.flatnonzero(text == 0)
        unlike = text + 0  # each 0 becomes a symbol of its own, so that suffixes differ
        unlike[ends] = words + 1 + np.arange(len(ends))
        order = suffix_array(unlike)
        self.last = text[order - 1]
        self.ranks = WaveletRanks(self.last, bits)
        counts = np.bincount(text[text > 0], minlength=words + 2)
        self.before = np.cumsum(counts) - counts  # rows of smaller words; the rows of 0 come last
        starts = np.r_[0, ends[:-1] + 1]
        offset = np.arange(self.size) - np.repeat(starts, ends - starts + 1)
        self.sampled = np.where(offset % self.STEP == 0, np.arange(self.size), -1)[order]

    def search(self, patterns: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with patterns[first : first + length], for many at once."""
        low, high = np.zeros(len(first), np.int64), np.full(len(first), self.size, np.int64)
        live = np.arange(len(first))
        for back in range(1, int(length.max(initial=0)) + 1):
            live = live[length[live] >= back]
            symbol = patterns[first[live] + length[live] - back]
            base = self.before[symbol]
            low[live] = base + self.ranks.rank(symbol, low[live])
            high[live] = base + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text of the given rows, by walking back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = self.sampled[rows[todo]]
            found = at >= 0
            out[todo[found]] = at[found] + steps[todo[found]]
            todo = todo[~found]
            symbol = self.last[rows[todo]]
            rows[todo] = self.before[symbol] + self.ranks.rank(symbol, rows[todo])
            steps[todo] += 1
        return out
