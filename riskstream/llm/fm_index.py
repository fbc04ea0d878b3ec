"""A compressed full-text index over words: the Burrows-Wheeler transform in a wavelet tree.

Texts are sequences of word hashes, each with an owner.  The index holds the transform of
all texts, with a separator after each, as one bit vector for each bit of a symbol (a
wavelet tree laid out level by level), and the owner of each place in suffix order
as a second such tree: about (log2 words + log2 owners) * 1.5 bits for a word of text, and no
table of suffixes.  Backward search prepends words to a pattern; all patterns of a
batch advance together, so a step is a fixed number of numpy operations whatever their number.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with rank: how many are set before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)]).astype(np.uint32)
        self.zeros = n - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[BitVector] = []
        self.depth = max(1, int(size - 1).bit_length())
        begin = np.zeros(size, np.int64)
        every = np.arange(size)
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            vector = BitVector(bits)
            self.levels.append(vector)
            ones = vector.rank(begin)
            begin = np.where((every >> level) & 1, vector.zeros + ones, begin - ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.begin = begin.astype(np.uint32)  # of each symbol on the last level

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[j] before at[j]."""
        for level, vector in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = vector.rank(at)
            at = np.where((symbol >> level) & 1, vector.zeros + ones, at - ones)
        return at - self.begin[symbol]

    def smaller(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether there is a symbol less than symbol[j] in [lo[j], hi[j])."""
        found = np.zeros(len(symbol), bool)
        left = np.arange(len(symbol))
        for level, vector in zip(range(self.depth - 1, -1, -1), self.levels):
            both = vector.rank(np.concatenate([lo, hi]))
            a, b = both[: len(lo)], both[len(lo) :]
            one = ((symbol >> level) & 1).astype(bool)
            # where the symbol's bit is set, any place whose bit is not holds a smaller one
            hit = one & (hi - lo > b - a)
            found[left[hit]] = True
            lo, hi = np.where(one, vector.zeros + a, lo - a), np.where(one, vector.zeros + b, hi - b)
            on = ~hit & (hi > lo)
            if not on.all():
                left, symbol, lo, hi = left[on], symbol[on], lo[on], hi[on]
                if not len(left):
                    break
        return found


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places in order of the `length` symbols, or more, that follow; by doubling."""
    rank = symbols.astype(np.int64)
    done = 1
    while done < length:
        after = np.zeros_like(rank)
        after[:-done] = rank[done:] + 1
        _, rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)
        if rank.max() == len(rank) - 1:
            break
        done *= 2
    return np.argsort(rank, kind="stable")


class Index:
    """Over texts shorter than `longest` words. owners: the id each text belongs to."""

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, longest: int):
        length = np.array([len(t) for t in texts])
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        self.n = int(length.sum() + len(texts))
        self.vocabulary, ids = np.unique(np.concatenate(texts), return_inverse=True)
        symbols = np.zeros(self.n, np.uint32)
        inside = np.ones(self.n, bool)
        inside[start + length] = False
        symbols[inside] = ids + 1
        order = suffix_order(symbols, longest)
        size = len(self.vocabulary) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.tree = WaveletTree(symbols[order - 1], size)
        self.owners, rank = np.unique(owners, return_inverse=True)
        self.owner = WaveletTree(np.repeat(rank, length + 1)[order].astype(np.uint32), len(self.owners))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol put before them."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.first[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching(self, texts: list[np.ndarray], asker: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        """(text, start, end) of the intervals of streamed texts whose matching statistics reach `least`.

        The matching statistic of a place is the length of the longest match that begins there, here with an
        indexed text of an owner smaller than asker[j]; the intervals together cover just the words inside matches
        of `least` words or more.  A target from the place on is searched from its end, first of all the rest of the text and
        of twice the length after each that is found.  If it is found, all of it matches; if a part of it fails, so
        does every longer match that holds this part, and the next place begins behind the failing word.  Text
        that matches nothing is passed in steps of almost `least` words for a few looked at.
        """
        out: list[tuple[int, int, int]] = []
        length = np.array([len(t) for t in texts], np.int64)
        start = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        words = np.concatenate(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbols = np.where(self.vocabulary[at] == words, at + 1, 0).astype(np.uint32)  # 0, the separator, for words that no text has
        rank = np.searchsorted(self.owners, asker)
        top = len(self.owners) - 1
        lane = np.flatnonzero((length >= least) & (rank > 0))
        i = np.zeros(len(lane), np.int64)
        e = length[lane].copy()
        grow = e.copy()
        p, lo, hi = e.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        while len(lane):
            p -= 1
            symbol = symbols[start[lane] + p].astype(np.int64)
            lo, hi = self.extend(symbol, lo, hi)
            ok = (hi > lo) & (symbol > 0)
            asked = rank[lane[ok]]
            # an asker beyond all owners has every owner before it
            ok[ok] = (asked > top) | self.owner.smaller(np.minimum(asked, top), lo[ok], hi[ok])
            found = ok & (p == i)
            failed = ~ok
            if not (found.any() or failed.any()):
                continue
            out.extend(zip(lane[found].tolist(), i[found].tolist(), e[found].tolist()))
            shortest = failed & (e == i + least)
            shorter = failed & ~shortest
            e[shorter] = (i[shorter] + least + e[shorter]) // 2
            grow[failed] = 0
            i[shortest] = p[shortest] + 1
            i[found] = e[found] - least + 1
            grow[found] = 2 * grow[found] + 1
            moved = found | shortest
            e[moved] = np.minimum(i[moved] + least + grow[moved], length[lane[moved]])
            again = found | failed
            p[again], lo[again], hi[again] = e[again], 0, self.n
            left = i + least <= length[lane]
            if not left.all():
                lane, i, e, grow, p, lo, hi = (x[left] for x in (lane, i, e, grow, p, lo, hi))
        return out
