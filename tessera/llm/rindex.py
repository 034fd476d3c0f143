"""A run-length index over a batch of similar byte strings, and its long matches.

The Burrows-Wheeler transform of similar strings has few runs.  Where a run
begins or ends, the index samples the text position and the length that it has
in common with its neighbour in suffix order.  From there matching statistics
are streamed through the text: inside a run, the position after one that
matches its neighbour for n bytes matches its own for n - 1 (these lengths are
reducible), so the samples give every position's longest match elsewhere.
"""

from __future__ import annotations

import numpy as np

#: Symbols packed into the first sorting key: 7 of 9 bits.
PACKED = 7


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """Suffixes in order, by doubling; and for each length sorted by, the ranks."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(PACKED):
        key = (key << 9) | padded[i : n + i]
    ranks, lengths, length = [], [], PACKED
    while True:
        order = np.argsort(key)
        new = np.concatenate([[False], np.diff(key[order]) != 0])
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new)
        ranks.append(rank)
        lengths.append(length)
        if not n or rank[order[-1]] == n - 1:
            return order, ranks, lengths
        key = rank.astype(np.int64) * (n + 1)
        if length < n:
            key[:-length] += rank[length:] + 1
        length *= 2


def common_length(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], lengths: list[int], symbols: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` have in common, from the ranks of all lengths."""
    n, out = len(symbols), np.zeros(len(a), np.int64)
    for rank, length in zip(reversed(ranks), reversed(lengths)):
        i, j = a + out, b + out
        fits = (i + length <= n) & (j + length <= n)
        same = fits & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        out += np.where(same, length, 0)
    for _ in range(PACKED):
        i, j = a + out, b + out
        fits = (i < n) & (j < n)
        same = fits & (symbols[np.minimum(i, n - 1)] == symbols[np.minimum(j, n - 1)])
        if not same.any():
            break
        out += same
    return out


class RunIndex:
    """Run-length BWT of ``strings`` (a 0 after each) with samples at the ends of its runs.

    Equal strings are compared byte for byte and sorted once: the suffixes of
    the copies stand beside each other in suffix order, so copies lengthen the
    runs and add none.
    """

    def __init__(self, strings: list[bytes]):
        place: dict[bytes, int] = {}
        self.which = np.array([place.setdefault(s, len(place)) for s in strings], np.int64)
        self.copies = np.bincount(self.which, minlength=len(place))
        distinct = list(place)
        sizes = np.array([len(s) for s in distinct], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.sizes = sizes
        raw = np.frombuffer(b"\0".join([*distinct, b""]), np.uint8)
        self.symbols = raw.astype(np.int16) + 1
        self.symbols[self.starts + sizes] = 0
        order, ranks, lengths = suffix_order(self.symbols)
        bwt = self.symbols[order - 1]
        # what follows a string's end isn't its own: runs of the end symbol are cut everywhere
        change = np.nonzero((np.diff(bwt) != 0) | (bwt[1:] == 0))[0] + 1
        #: Run-length form: where runs begin in suffix order, their symbol, and their length with all copies.
        self.heads = np.concatenate([[0], change])
        self.letters = bwt[self.heads]
        weight = np.repeat(self.copies, sizes + 1)
        self.lengths = np.add.reduceat(weight[order], self.heads)
        # samples: text positions at the beginnings and the ends of runs, and what they share across the border
        self.first, self.last = order[change], order[change - 1]
        self.shared = common_length(self.first, self.last, ranks, lengths, self.symbols)
        self.ends = order[0], order[-1]

    def matching_statistics(self) -> np.ndarray:
        """For each position of the distinct strings, the length of its longest match with any other position."""
        n = len(self.symbols)
        out = np.zeros(n, np.int64)
        for sample, alone in ((self.first, self.ends[0]), (self.last, self.ends[1])):
            at = np.concatenate([sample, [alone]])
            length = np.concatenate([self.shared, [0]])
            by = np.argsort(at)
            at, length = at[by], length[by]
            k = np.searchsorted(at, np.arange(n), side="right") - 1
            # the last position of the text precedes the first: it starts from its own sample
            stream = np.where(k >= 0, length[k] - (np.arange(n) - at[k]), length[-1] - (np.arange(n) + n - at[-1]))
            np.maximum(out, stream, out=out)
        # a suffix that has copies has one for neighbour: they agree to their end
        ends = np.repeat(self.starts + self.sizes, self.sizes + 1)
        return np.where(np.repeat(self.copies > 1, self.sizes + 1), np.maximum(out, ends - np.arange(n)), out)

    def repeated(self, width: int) -> list[np.ndarray]:
        """For each string, which of its windows of ``width`` bytes also start elsewhere."""
        if not len(self.which):
            return []
        long = self.matching_statistics() >= width
        of = [long[a : a + max(0, n - width + 1)] for a, n in zip(self.starts.tolist(), self.sizes.tolist())]
        return [of[k] for k in self.which.tolist()]
