"""Benchmark decontamination: the benchmark's word windows as a broadcast hash set, documents scanned whole.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.
Every word of a document that lies inside an occurrence of a window is hit. Candidate positions are found
with a rolling hash over word numbers and each is confirmed word by word.

The benchmark is broadcast in blocks of at most ``max_windows`` windows, so its share of memory is bounded
whatever its size; the documents are passed over once per block, without a shuffle.

Defined results: NULL, empty and word-less texts have no words and no hits; NULL and word-less items are
never found; an item without an id counts under the id ''; repeated rows and items of one id are scanned
alike and counted once; an empty benchmark hits nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z and all beyond ASCII
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FOUND = "struct<n_words:bigint,spans:array<struct<first:int,last:int>>,items:array<string>>"


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(NORMAL).split()


class Windows:
    """All windows of some items, looked up by word numbers."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in normal_words(text)]
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                self.items.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.hashes = {}
        for n in {len(w) for w in self.items}:
            table = np.array([w for w in self.items if len(w) == n], np.uint64)
            self.hashes[n] = np.unique(self._hash(table.reshape(-1), n)[::n])

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
        for k in range(n):
            total = (total + ids[k : k + len(total)]) * FACTOR
        return total

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and by which items."""
        hit, items = np.zeros(len(words), bool), set()
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.uint64, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes in self.hashes.items():
            if n > len(words):
                continue
            # only windows made of the benchmark's words can match
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(at):
                continue
            found = self._hash(ids, n)[at]
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            for i in at[hashes[place] == found].tolist():
                window = tuple(ids[i : i + n].tolist())
                if window in self.items:
                    hit[i : i + n] = True
                    items |= self.items[window]
        return hit, items


def _runs(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan_block(df: DataFrame, items: list[tuple[str, str]], width: int) -> DataFrame:
    """``df`` (row, text, found) with the hits of one block of items merged into ``found``."""
    shared = df.sparkSession.sparkContext.broadcast(Windows(items, width))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            found = []
            for text, before in zip(batch["text"].to_pylist(), batch["found"].to_pylist(), strict=True):
                words = normal_words(text)
                hit, names = windows.scan(words)
                if before:
                    names |= set(before["items"])
                    for span in before["spans"]:
                        hit[span["first"] : span["last"] + 1] = True
                found.append({"n_words": len(words), "spans": _runs(hit) if hit.any() else [], "items": sorted(names)})
            at = batch.schema.get_field_index("found")
            yield batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))

    return df.mapInArrow(scan, df.schema)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    width: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    max_windows: int = 1_000_000,
    pass_rows: Column | None = None,
) -> DataFrame:
    """``row`` (``pass_rows``, by default the whole row), text and ``found``: n_words, spans of hit words, items."""
    tests = benchmark.where(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")
    )
    # a text has at most as many windows as half its characters and one
    size = tests.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(size // max_windows) + 1
    row = F.struct("*") if pass_rows is None else pass_rows
    df = docs.select(row.alias("row"), F.col(text).alias("text"), F.lit(None).cast(FOUND).alias("found"))
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        df = _scan_block(df, [tuple(r) for r in part.collect()], width)
    return df


def _without_spans(text: str, spans: list[dict]) -> str:
    """The text without its hit words; what stood between two words of a span goes with them."""
    data = text.encode()
    normal = data.translate(NORMAL)
    starts, ends, at = [], [], 0
    for word in normal.split():
        at = normal.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    kept, at = [], 0
    for span in spans:
        kept.append(data[at : starts[span["first"]]])
        at = ends[span["last"]]
    return b"".join([*kept, data[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_hit_share: float = 0.5, **options) -> DataFrame:
    """``docs`` with hit spans cut out of the text; documents hit in more than ``max_hit_share`` are removed.

    Documents without a hit come out as they are.
    """
    found = scan(docs, benchmark, text, **options)
    n_hit = F.aggregate("found.spans", F.lit(0), lambda a, s: a + s["last"] - s["first"] + 1)
    kept = found.where(n_hit <= F.lit(max_hit_share) * F.col("found.n_words"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [
                _without_spans(t, f["spans"]) if f["spans"] else t
                for t, f in zip(batch["text"].to_pylist(), batch["found"].to_pylist(), strict=True)
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    cleaned = kept.mapInArrow(cut, kept.schema)
    columns = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cleaned.select(*columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit."""
    return scan(docs, benchmark, text, **options).where(F.size("found.spans") == 0).select("row.*")
