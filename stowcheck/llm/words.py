"""Words and row identity shared by the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# white space of the word pattern [^\x20\x09-\x0D]+; bytes.split() splits on the same six characters
SPACE = r"[\x20\x09-\x0D]+"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; NULL has none."""
    return [] if text is None else text.encode().translate(LOWER).split()


def word_array(text: Column) -> Column:
    """The same words as a SQL array, their case kept; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


_factors = np.zeros(0, np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word: its bytes times random odd numbers by place, summed and mixed."""
    global _factors
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if lengths.max() > len(_factors):
        draw = np.random.Generator(np.random.PCG64(1))
        _factors = draw.integers(0, 1 << 63, 2 * int(lengths.max()), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(data * _factors[place], starts))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_powers = np.zeros((2, 0), np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers from 0 of ``_STEP`` and of its inverse, modulo 2**64."""
    global _powers
    if n > _powers.shape[1]:
        each = np.ones((2, 2 * n), np.uint64)
        each[:, 1:] = np.array([[_STEP], [pow(_STEP, -1, 1 << 64)]], np.uint64)
        _powers = np.multiply.accumulate(each, axis=1)
    return _powers


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of ``width`` consecutive words.

    It mixes the sum of the words' hashes times ``_STEP`` to the power of their distance from the window's end,
    which is a difference of running sums.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * down[: len(hashes)], out=total[1:])
    return mixed((total[width:] - total[:n]) * up[width : width + n])


def text_digest(text: Column) -> Column:
    """Tells rows of one doc_id apart; NULL and empty texts differ."""
    return F.xxhash64(F.coalesce(text, F.lit("\0null")))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A repeatable number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def rows_where(df: DataFrame, flag: Column) -> DataFrame:
    """``df`` where ``flag`` holds, decided after its columns are computed.

    A filter would be pushed below them, with their expressions written out in place of their names, and
    array expressions would then be computed anew for every element of another one.
    """
    name = "_kept_row"
    return df.select("*", F.explode(F.when(flag, F.array(F.lit(True)))).alias(name)).drop(name)
