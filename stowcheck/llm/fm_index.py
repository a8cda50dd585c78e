"""A bidirectional FM-index of a delimited vocabulary, searched with at most one error.

The text is ``|w1|w2|...|wn|``, taken as a ring, with ``|`` below all other symbols; words are distinct. A pattern
is held as a pair of suffix-rank intervals of equal size, one in the index of the text and one in that of its
reverse, so it can be extended by a symbol on either side. All patterns of a batch are extended at once, in numpy.

Search scheme for words with exactly one inserted, deleted or replaced symbol: one error lies in one half of
the query, so the other half is matched exactly, with the delimiter at its outer end, and then extended across
the half with the error up to the delimiter at the other end.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8
ENUMERATED = 64
QUERIES_AT_ONCE = 20_000
# bits of the first 0 to 7 places of a block
BEFORE = (0xFF00 >> np.arange(SAMPLE) & 0xFF).astype(np.uint8)


def _ranks_of_rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of ``text`` in order, by prefix doubling; all rotations differ."""
    n, width = len(text), 8
    # the first eight symbols at once
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | np.roll(text, -k).astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * n + np.roll(rank, -width)
        order = np.argsort(key)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class Ranks:
    """How often symbols below a given one occur before a rank, for one direction of the text."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.order = _ranks_of_rotations(text)
        last = text[self.order - 1]
        blocks = n // SAMPLE + 1
        counts = np.bincount(np.arange(n) // SAMPLE * symbols + last, minlength=blocks * symbols).reshape(blocks, symbols)
        before = np.zeros((blocks, symbols + 1), np.int64)
        np.cumsum(np.cumsum(counts, axis=0)[:-1], axis=1, out=before[1:, 1:])
        self.sampled = before.astype(np.int32)
        padded = np.full(blocks * SAMPLE, 255, np.uint8)
        padded[:n] = last
        self.last, self.rows = last, padded.reshape(blocks, SAMPLE)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def below(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        block = rank // SAMPLE
        return self.sampled[block, symbol] + self._inside(self.rows[block] < symbol.astype(np.uint8)[:, None], rank)

    def below_and_equal(self, symbol: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often smaller symbols and how often ``symbol`` itself occur before a rank."""
        block, own = rank // SAMPLE, symbol.astype(np.uint8)[:, None]
        rows, below = self.rows[block], self.sampled[block, symbol]
        equal = self.sampled[block, symbol + 1] - below
        return below + self._inside(rows < own, rank), equal + self._inside(rows == own, rank)

    @staticmethod
    def _inside(marks: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of a row's marks stand before the rank's place in its block; a row is one byte of bits."""
        return np.bitwise_count(np.packbits(marks.reshape(-1)) & BEFORE[rank % SAMPLE])

    def extended(self, symbol, lo, other_lo, size):
        """The pair of intervals after a symbol is put before the pattern (in this direction)."""
        low, first = self.below_and_equal(symbol, lo)
        # an interval of one rank holds one symbol
        last = self.last[lo]
        between, left = (last < symbol).astype(np.int64), (last == symbol).astype(np.int64)
        wide = np.flatnonzero(size != 1)
        high, until = self.below_and_equal(symbol[wide], lo[wide] + size[wide])
        between[wide], left[wide] = high - low[wide], until - first[wide]
        return self.starts[symbol] + first, other_lo + between, left


class Vocabulary:
    """An index of distinct words; at most 253 different symbols."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer(("|" + "|".join(words) + "|").encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        delimiters = np.concatenate([[0], np.cumsum(lengths + 1)])
        is_delimiter = np.zeros(len(points), bool)
        is_delimiter[delimiters] = True
        self.alphabet = np.unique(points[~is_delimiter])
        if len(self.alphabet) > 253:
            raise ValueError("too many symbols for one index")
        text = self._symbols(points)
        text[is_delimiter] = 0
        symbols = len(self.alphabet) + 1
        self.ranks = [Ranks(text, symbols), Ranks(text[::-1].copy(), symbols)]
        # the word that a delimiter stands before, in either direction
        self.word_at = [np.full(len(text), -1), np.full(len(text), -1)]
        self.word_at[0][delimiters[:-1]] = np.arange(len(words))
        self.word_at[1][len(text) - 1 - delimiters[1:]] = np.arange(len(words))

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; of those the index doesn't have, one past the last."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, len(self.alphabet) + 1)

    def one_error(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a query, number of a word) of words one error away, each pair once."""
        found = [np.zeros((2, 0), np.int64)]
        for k in range(0, len(queries), QUERIES_AT_ONCE):
            part = queries[k : k + QUERIES_AT_ONCE]
            for backward in (False, True):
                pairs = self._search(part, backward)
                found.append(np.stack([pairs[0] + k, pairs[1]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def _search(self, queries: list[str], backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Errors in the second half; ``backward`` swaps both directions, so there errors lie in the first."""
        outward, inward = self.ranks[backward], self.ranks[not backward]
        end = np.int64(0)
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        exact = lengths - lengths // 2 if backward else lengths // 2
        texts = [q[::-1] for q in queries] if backward else queries
        symbols = self._symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)) if lengths.sum() else np.zeros(0, np.int64)
        first = np.cumsum(lengths) - lengths
        unknown = len(self.alphabet) + 1

        def extend(ranks, symbol, lo, other, size):
            """``ranks.extended``; nothing is left of a pattern that takes an unknown symbol."""
            known = symbol < unknown
            lo, other, left = ranks.extended(np.where(known, symbol, 0), lo, other, size)
            return lo, other, np.where(known, left, 0)

        # the exact half from its inner end outwards, then the delimiter
        n = len(outward.last)
        query = np.arange(len(queries))
        lo, other, size = (np.zeros(len(queries), np.int64) for _ in range(3))
        size += n
        for t in range(int(exact.max(initial=0)) + 1):
            going = t <= exact[query]
            symbol = np.zeros(len(query), np.int64)
            inside = t < exact[query]
            symbol[inside] = symbols[first[query[inside]] + exact[query[inside]] - 1 - t]
            a, b, s = extend(outward, symbol[going], lo[going], other[going], size[going])
            lo[going], other[going], size[going] = a, b, s
            alive = size > 0
            query, lo, other, size = query[alive], lo[alive], other[alive], size[alive]

        def symbol_at(query, place):
            """The query's symbol, or the delimiter after its last."""
            symbol = np.zeros(len(query), np.int64)
            inside = place < lengths[query]
            symbol[inside] = symbols[first[query[inside]] + place[inside]]
            return symbol

        place = exact[query]
        wrong = [np.zeros(0, np.int64) for _ in range(5)]  # query, place, lo, other, size
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query) or len(wrong[0]):
            started = []
            if len(query):
                of, symbol = self._next_symbols(inward, other, size)
                a, b, s = inward.extended(symbol, other[of], lo[of], size[of])
                wanted, inner = symbol_at(query, place), place < lengths[query]
                differs = (symbol != wanted[of]) & (symbol != end)
                replaced, inserted = differs & inner[of], differs
                # of equal neighbours only the last is deleted, and none is inserted before its equal
                deleted = inner & (symbol_at(query, place + 1) != wanted)
                started = [
                    (query[of][replaced], place[of][replaced] + 1, b[replaced], a[replaced], s[replaced]),
                    (query[of][inserted], place[of][inserted], b[inserted], a[inserted], s[inserted]),
                    (query[deleted], place[deleted] + 1, lo[deleted], other[deleted], size[deleted]),
                ]
                same = (symbol == wanted[of]) & inner[of]
                query, place, lo, other, size = query[of][same], place[of][same] + 1, b[same], a[same], s[same]
            if len(wrong[0]):
                q, p, forward, reverse, many = wrong
                symbol = symbol_at(q, p)
                reverse, forward, many = extend(inward, symbol, reverse, forward, many)
                alive = many > 0
                done = alive & (p == lengths[q])
                hits.append((q[done], self.word_at[backward][outward.order[forward[done]]]))
                alive &= p < lengths[q]
                wrong = [q[alive], p[alive] + 1, forward[alive], reverse[alive], many[alive]]
            wrong = [np.concatenate(c) for c in zip(wrong, *started, strict=True)]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in hits]), np.concatenate([w for _, w in hits])

    def _next_symbols(self, ranks: Ranks, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, symbol) for every symbol that continues a pattern; all symbols for large intervals, where
        some may continue nothing."""
        symbols = len(self.alphabet) + 1
        small = np.flatnonzero(size <= ENUMERATED)
        many = size[small]
        of = np.repeat(small, many)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        seen = np.unique(of * symbols + ranks.last[lo[of] + offset])
        large = np.flatnonzero(size > ENUMERATED)
        every = (large[:, None] * symbols + np.arange(symbols)).reshape(-1)
        both = np.concatenate([seen, every])
        of, symbol = both // symbols, both % symbols
        if len(large):
            left = ranks.below(symbol + 1, lo[of] + size[of]) - ranks.below(symbol, lo[of] + size[of])
            left -= ranks.below(symbol + 1, lo[of]) - ranks.below(symbol, lo[of])
            of, symbol = of[left > 0], symbol[left > 0]
        return of, symbol
