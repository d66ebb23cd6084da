"""A bidirectional FM-index over a delimited vocabulary, searched for many words at once with numpy.

The text is the words with a delimiter before, between and behind them. Its Burrows-Wheeler transform and that of the
reversed text are kept as wavelet matrices, which give the rank of a symbol and the number of smaller symbols in an
interval. With both, a match keeps its interval of suffix ranks in either index while it grows to the left or right.
"""

from __future__ import annotations

import numpy as np

from .bytescan import ragged

#: Symbols before the letters: the text's end, and the delimiter.
END, GAP = 0, 1
#: Intervals up to this size list their symbols; larger ones try all letters.
NARROW = 64


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array by prefix doubling, beginning with as many symbols as fit into 63 bits. The last symbol is unique."""
    n, width = len(text), max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    for i in range(width):
        key = key << bits | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + behind
        width *= 2


class Ranks:
    """Wavelet matrix of a transform: backward steps of many intervals at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.symbols, self.bits = symbols, bits
        self.zeros: list[np.ndarray] = []
        level = symbols
        for b in range(bits - 1, -1, -1):
            bit = level >> b & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        counts = np.bincount(symbols, minlength=1 << bits)
        every = np.arange(1 << bits)
        first = np.zeros(1 << bits, np.int64)
        _, place, _ = self.walk(every, first, first)
        # from places in the last level to ranks of suffixes
        self.shift = np.cumsum(counts) - counts - place

    def walk(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(c), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            one = c >> b & 1 == 1
            a, z = zeros[low], zeros[high]
            smaller += np.where(one, z - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - z, z)
        return smaller, low, high

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of ``c`` put before the match, and how many symbols before it are smaller than ``c``."""
        smaller, low, high = self.walk(c, low, high)
        return low + self.shift[c], high + self.shift[c], smaller


class Vocabulary:
    """Distinct words, indexed in both directions."""

    def __init__(self, words: list[str]):
        joined = "\n".join(words)
        points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(points[points != 10])
        symbols = np.searchsorted(self.alphabet, points) + 2
        symbols[points == 10] = GAP
        self.size = len(self.alphabet) + 2
        self.bits = max(1, int(self.size - 1).bit_length())
        self.text = symbols
        self.starts = np.flatnonzero(symbols == GAP)[:-1] if words else np.zeros(0, np.int64)
        self.lengths = np.diff(np.flatnonzero(symbols == GAP)) - 1 if words else np.zeros(0, np.int64)
        self.ranks = []
        for direction in (symbols, symbols[::-1]):
            text = np.append(direction, END)
            order = suffix_order(text, self.bits)
            self.ranks.append(Ranks(text[order - 1], self.bits))
            if len(self.ranks) == 1:
                # the suffixes that begin with a delimiter come first, behind the end; the last of them is no word
                begin = order[1 : 2 + len(words)]
                self.word_of = np.searchsorted(self.starts, begin)

    def extend(self, c: np.ndarray, spans: np.ndarray, right: bool) -> np.ndarray:
        """Matches grown by one symbol. ``spans``: low rank in this index, low rank in the other, size."""
        near, far = (1, 0) if right else (0, 1)
        low, high, smaller = self.ranks[near].step(c, spans[near], spans[near] + spans[2])
        out = np.empty_like(spans)
        out[near], out[far], out[2] = low, spans[far] + smaller, high - low
        return out

    def branches(self, spans: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which match can grow by which letter: match numbers and letters, some of which may lead nowhere."""
        near = 1 if right else 0
        narrow = np.flatnonzero(spans[2] <= NARROW)
        owner = np.repeat(narrow, spans[2][narrow])
        letter = self.ranks[near].symbols[ragged(spans[near][narrow], spans[2][narrow])]
        pair = np.unique(owner * self.size + letter)
        wide = np.flatnonzero(spans[2] > NARROW)
        letters = np.arange(2, self.size)
        pair = np.concatenate([pair[pair % self.size >= 2], (wide[:, None] * self.size + letters).ravel()])
        return pair // self.size, pair % self.size

    def near(self, which: np.ndarray, left_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words with one letter inserted, deleted or replaced outside of an exact half: pairs of places in ``which`` and
        word numbers, each once.

        A word of L letters is cut behind L // 2 of them. The exact half grows from the cut outwards, over its
        delimiter; then the match turns and grows over the other half with one error, up to the other delimiter.
        """
        length = self.lengths[which]
        cut = 1 + length // 2  # in the word with its delimiters
        at = self.starts[which]
        exact_right, right = not left_half, left_half
        inner = (cut, length + 2 - cut) if left_half else (length + 2 - cut, cut)

        def symbol(query: np.ndarray, j: np.ndarray, to_right: bool) -> np.ndarray:
            """The j-th symbol from the cut."""
            return self.text[at[query] + np.where(to_right, cut[query] + j, cut[query] - 1 - j)]

        query = np.arange(len(which))
        spans = np.zeros((3, len(which)), np.int64)
        spans[2] = len(self.text) + 1
        done = np.zeros((3, len(which)), np.int64)
        for j in range(int(inner[0].max(initial=0))):
            spans = self.extend(symbol(query, j, exact_right), spans, exact_right)
            full = inner[0][query] == j + 1
            done[:, query[full]] = spans[:, full]
            query, spans = query[~full], spans[:, ~full]

        query, spans, last = np.arange(len(which)), done, inner[1] - 1
        pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(int(last.max(initial=-1)) + 1):
            expected = symbol(query, j, right)
            owner, letter = self.branches(spans, right)
            other = letter != expected[owner]
            owner, letter = owner[other], letter[other]
            grown = self.extend(letter, spans[:, owner], right)
            some = grown[2] > 0
            owner, grown = owner[some], grown[:, some]
            pool.append((query[owner], np.full(len(owner), j), grown))  # inserted
            inside = j < last[query]
            real = inside[owner]
            pool.append((query[owner[real]], np.full(int(real.sum()), j + 1), grown[:, real]))  # replaced
            # of equal letters in a row the last is deleted
            ahead = np.where(inside, symbol(query, np.minimum(j + 1, last[query]), right), GAP)
            gone = inside & (ahead != expected)
            pool.append((query[gone], np.full(int(gone.sum()), j + 1), spans[:, gone]))
            spans = self.extend(expected, spans, right)
            query, spans = query[inside], spans[:, inside]

        query = np.concatenate([p[0] for p in pool]) if pool else query
        j = np.concatenate([p[1] for p in pool]) if pool else query
        spans = np.concatenate([p[2] for p in pool], axis=1) if pool else spans
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            spans = self.extend(symbol(query, j, right), spans, right)
            alive = spans[2] > 0
            over = alive & (j == last[query])
            found.append((query[over], self.word_of[spans[0][over] - 1]))
            alive &= ~over
            query, j, spans = query[alive], j[alive] + 1, spans[:, alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
