"""Simple-8b: unsigned integers packed into 64-bit words, coded and decoded with numpy.

The upper four bits of a word select how its other 60 bits are used: selector s < 14 holds COUNTS[s] values of
BITS[s] bits, the first in the lowest bits; RUN holds one value of 32 bits and how often it repeats; ESCAPE holds
the place of a value of more than 60 bits in a list of exceptions. So every word of a stream starts with a
selector, and all words of a stream are decoded at once. Values are packed in blocks of BLOCK, and no word
reaches across blocks: with the offset of each block any part of a stream can be decoded by itself.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
RUN, ESCAPE = 14, 15
RUN_BITS = 32
_LIMITS = np.array([1 << int(b) for b in BITS], np.uint64)
_KIND_OF_BITS = np.searchsorted(BITS, np.arange(54)).astype(np.int8)
_U = np.uint64


def encode(values: np.ndarray, first_exception: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words per block, exceptions) of ``values``; exceptions are numbered from ``first_exception``.

    A word takes the selector of most values that fits at its place. Which fits is found for all places at
    once; then all blocks are walked side by side, a word of each per step.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # smallest selector class a value fits; places past a block's end fit nothing
    kind = np.full((blocks, BLOCK + int(COUNTS[0])), 16, np.int8)
    kind[:, :BLOCK] = _kinds(values, blocks * BLOCK).reshape(blocks, BLOCK)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    # the selector of most values whose widest value fits, for every place; windows of 2 to 60 places are
    # made of two shorter ones
    chosen = np.where(kind[:, :BLOCK] == 14, ESCAPE, 13).astype(np.int8)
    widest = {1: kind}
    for s in range(12, max(-1, int(kind.min()) - 1), -1):
        count = int(COUNTS[s])
        half = min(c for c in widest if 2 * c >= count)
        longer = np.maximum(widest[half][:, : half - count or None], widest[half][:, count - half :])
        widest[count] = longer
        np.putmask(chosen, longer[:, :BLOCK] <= s, np.int8(s))
    take = COUNTS.astype(np.int32)[np.minimum(chosen, 13)]
    equal = flat[1:] == flat[:-1]
    if (equal[2:] & equal[1:-1] & equal[:-2]).any():
        left = _run_lengths(flat.reshape(blocks, BLOCK), n)
        runs = (left > take) & (kind[:, :BLOCK] <= 13) & (flat.reshape(blocks, BLOCK) < _U(1 << RUN_BITS))
        chosen[runs], take[runs] = RUN, left[runs]

    lengths = np.full(blocks, BLOCK, np.int64)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        place = at[live]
        steps.append((live, place))
        at[live] = place + take[live, place]
        live = live[at[live] < lengths[live]]
    block = np.concatenate([b for b, _ in steps])
    place = np.concatenate([p for _, p in steps])
    step = np.repeat(np.arange(len(steps)), [len(b) for b, _ in steps])
    per_block = np.bincount(block, minlength=blocks)
    target = (np.cumsum(per_block) - per_block)[block] + step
    start, selector = block * BLOCK + place, chosen[block, place]

    words = np.zeros(len(block), np.uint64)
    for s in np.unique(selector):
        of = selector == s
        first = start[of]
        if s == ESCAPE:
            order = np.argsort(first, kind="stable")
            body = np.empty(len(first), np.uint64)
            body[order] = _U(first_exception) + np.arange(len(first), dtype=np.uint64)
            exceptions = flat[first[order]]
        elif s == RUN:
            body = flat[first] | (take[block[of], place[of]].astype(np.uint64) << _U(RUN_BITS))
        else:
            body = flat[first]
            for k in range(1, int(COUNTS[s])):
                body = body | (flat[first + k] << _U(k * int(BITS[s])))
        words[target[of]] = body | (_U(int(s)) << _U(60))
    if ESCAPE not in selector:
        exceptions = np.zeros(0, np.uint64)
    return words, per_block, exceptions


def _kinds(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest selector class of each value, 14 for an exception; 16 past the end."""
    kind = np.full(size, 16, np.int8)
    if len(values) and values.max() < 1 << 53:
        # exact below 2^53: the exponent is the number of bits
        kind[: len(values)] = _KIND_OF_BITS[np.frexp(values.astype(np.float64))[1]]
    else:
        kind[: len(values)] = np.searchsorted(_LIMITS, values, side="right")
    return kind


def _run_lengths(values: np.ndarray, n: int) -> np.ndarray:
    """For every place, how many equal values follow from it on, itself included, within its block."""
    blocks = len(values)
    ends = np.ones((blocks, BLOCK), bool)
    ends[:, :-1] = values[:, 1:] != values[:, :-1]
    ends.reshape(-1)[n - 1] = True
    last = np.flatnonzero(ends.reshape(-1))
    until = np.repeat(last, np.diff(last, prepend=-1))
    return (until - np.arange(blocks * BLOCK) + 1).reshape(blocks, BLOCK)


def decode(words: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """The values of any whole blocks."""
    selector = (words >> _U(60)).astype(np.int64)
    count = np.ones(len(words), np.int64)
    plain = selector < RUN
    count[plain] = COUNTS[selector[plain]]
    runs = selector == RUN
    count[runs] = ((words[runs] >> _U(RUN_BITS)) & _U((1 << 28) - 1)).astype(np.int64)
    ends = np.cumsum(count)
    starts = ends - count
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        of = selector == s
        word, first = words[of], starts[of]
        if s == ESCAPE:
            out[first] = exceptions[(word & _U((1 << 60) - 1)).astype(np.int64)]
        elif s == RUN:
            many = count[of]
            offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out[np.repeat(first, many) + offset] = np.repeat(word & _U((1 << RUN_BITS) - 1), many)
        else:
            bits = int(BITS[s])
            mask = _U((1 << bits) - 1)
            for k in range(int(COUNTS[s])):
                out[first + k] = (word >> _U(k * bits)) & mask
    return out
