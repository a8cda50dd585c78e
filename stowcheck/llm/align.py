"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how common each pair is.

Every text is encoded twice. Byte offsets where tokens of both end cut them into groups; tokens of both sides in
one group are linked. A pair's count is the number of documents that hold it linked.

Counting is by external spill. Each task gathers (pair, document, links) records of a bounded number of documents,
a chunk, sorts them by pair with the A side major, and deals them by radix digits of the A id into runs. Runs are
stored once: the keys with the chunk's document counts as zstd frames, and beside them the records of documents.
Per radix the key runs of all chunks are merged on a heap, which sums the documents of each pair; all pairs of an
A id pass together, which yields its highest count. Then each run is streamed again and given the counts of its
keys. The counts go back to their chunk, where the stored records turn them into sums per document. Records of
documents never move to the merge: a pair found in a third of all documents is one entry per chunk there.

Defined results: NULL and empty texts, and texts whose tokens of either side don't spell a space and the text,
have no tokens; a NULL id stays NULL; repeated rows are documents of their own, in the result and in the counts;
an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.pair_runs import Spilled, packed, run_bytes, unpacked
from stowcheck.llm.tables import stored

RADIX_BITS = 6
CHUNK_RECORDS = 2_000_000
CHUNK_DOCS = 1 << 14
WIDE_GROUP = 1 << 16
# a record: A id, B id, document of the chunk
A_BITS, B_BITS, DOC_BITS = 24, 24, 16

DOC_FIELDS = [("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())]
ENCODED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("radix", pa.int32()), ("doc", pa.int64()), *DOC_FIELDS,
                     ("keys", pa.binary()), ("records", pa.binary())])
ENCODED_DDL = (
    "kind int, chunk long, radix int, doc long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, keys binary, records binary"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                          ("groups_sha256", pa.string())])
KEYS_ROW, DOC_ROW = 1, 2

# --- tokenizers -----------------------------------------------------------------------------------


class Side:
    """What a tokenizer's ids spell: bytes, their number, and decimal texts with each separator behind."""

    def __init__(self, spelled: list[bytes], inner: str, last: str):
        self.spelled = spelled
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.texts = [f"{i}{inner}" for i in range(len(spelled))] + [f"{i}{last}" for i in range(len(spelled))]

    def join(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


# tiktoken's pattern overruns its stack on some hundred thousand white spaces in a row
_LONG_SPACE = re.compile(r"\s{20000}")


class Tokenizers:
    """Byte-level BPE (A) and SentencePiece (B).

    A is given twice, as a tiktoken file of ranks with its pattern, which is several times faster, and as the same
    vocabulary for the tokenizers library, which encodes texts with very long white space.
    """

    def __init__(self, ranks_path: str, pattern: str, vocabulary_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken

        self.vocabulary_path, self.slow_a = vocabulary_path, None
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            spelled[i] = token
        self.side_a = Side(spelled, ",", "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        as_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.side_b = Side(as_bytes, ",", ";")
        self.texts = self.side_a.texts + self.side_b.texts

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for every text, or None where they don't spell it."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            if not text:
                yield None
                continue
            whole = (" " + text).encode()
            a = self._encode_a(" " + text)
            if self.side_a.join(a) == whole and self.side_b.join(b) == whole:
                yield np.array(a, np.int64), np.array(b, np.int64)
            else:
                yield None


    def _encode_a(self, text: str) -> list[int]:
        if len(text) < 20_000 or not _LONG_SPACE.search(text):
            return self.a.encode_ordinary(text)
        if self.slow_a is None:
            from tokenizers import Tokenizer

            self.slow_a = Tokenizer.from_file(self.vocabulary_path)
            # strings of special tokens are text like any other
            self.slow_a.encode_special_tokens = True
        return self.slow_a.encode(text, add_special_tokens=False).ids


_loaded: dict[tuple[str, ...], Tokenizers] = {}


def tokenizers(*paths: str) -> Tokenizers:
    if paths not in _loaded:
        _loaded[paths] = Tokenizers(*paths)
    return _loaded[paths]


# --- one text -------------------------------------------------------------------------------------


class Aligned:
    """Groups of one text's tokens."""

    def __init__(self, both: Tokenizers, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        ends_a, ends_b = np.cumsum(both.side_a.lengths[a]), np.cumsum(both.side_b.lengths[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.n_groups = len(cuts)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        self.size_a = np.bincount(self.group_a, minlength=self.n_groups)
        self.size_b = np.bincount(self.group_b, minlength=self.n_groups)
        self.n_links = int((self.size_a * self.size_b).sum())

    def text(self, both: Tokenizers) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[np.cumsum(self.size_a) - 1] = True
        last_b[np.cumsum(self.size_b) - 1] = True
        n_a, n_b = len(both.side_a.spelled), len(both.side_b.spelled)
        names = np.zeros(len(self.a) + len(self.b), np.int64)
        before_b = np.cumsum(self.size_b) - self.size_b
        names[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + n_a * last_a
        names[np.arange(len(self.b)) + np.cumsum(self.size_a)[self.group_b]] = 2 * n_a + self.b + n_b * last_b
        return "".join(map(both.texts.__getitem__, names.tolist()))[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, links each stands for): a pair of ids may occur again, except in wide groups."""
        wide = self.size_a * self.size_b > WIDE_GROUP
        first_b = np.cumsum(self.size_b) - self.size_b
        narrow = ~wide[self.group_a]
        many = self.size_b[self.group_a] * narrow
        of = np.repeat(np.arange(len(self.a)), many)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        found = [pair_key(self.a[of], self.b[first_b[self.group_a[of]] + inside])]
        links = [np.ones(len(of), np.int32)]
        for g in np.flatnonzero(wide):
            # ids of a wide group and how often each occurs, instead of its tokens
            ids_a, n_a = np.unique(self.a[self.group_a == g], return_counts=True)
            ids_b, n_b = np.unique(self.b[self.group_b == g], return_counts=True)
            found.append(pair_key(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a))))
            links.append(np.repeat(n_a, len(ids_b)) * np.tile(n_b, len(ids_a)))
        return np.concatenate(found), np.concatenate(links)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(B_BITS)) | b.astype(np.uint64)


# --- chunks of documents ----------------------------------------------------------------------------


class Chunk:
    """Records of the documents a task has read since its last spill."""

    def __init__(self, number: int, radix_bits: int):
        self.number, self.radix_bits = number, radix_bits
        self.docs: list[tuple] = []
        self.records: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.size, self.weighted = 0, False

    def add(self, doc_id: int | None, aligned: Aligned | None, both: Tokenizers) -> None:
        doc = len(self.docs)
        if aligned is None:
            self.docs.append((doc_id, 0, 0, 0, 0, ""))
            return
        digest = hashlib.sha256(aligned.text(both).encode()).hexdigest()
        self.docs.append((doc_id, len(aligned.a), len(aligned.b), aligned.n_groups, aligned.n_links, digest))
        pairs, links = aligned.pairs()
        self.records.append((pairs << np.uint64(DOC_BITS)) | np.uint64(doc))
        self.links.append(links)
        self.size += len(pairs)
        self.weighted |= bool((links > 1).any())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row per document, and one per radix with its run of keys and its records."""
        n = len(self.docs)
        columns = {"kind": [DOC_ROW] * n, "chunk": [self.number] * n, "doc": range(n)}
        columns |= {name: values for (name, _), values in zip(DOC_FIELDS, zip(*self.docs, strict=True), strict=True)}
        yield _encoded(columns, n)
        if not self.size:
            return
        records = np.concatenate(self.records)
        self.records.clear()
        if self.weighted:
            order = np.argsort(records)
            records, links = records[order], np.concatenate(self.links)[order]
            starts = np.flatnonzero(np.diff(records, prepend=~records[0]))
            links = np.add.reduceat(links, starts)
        else:
            records.sort()
            starts = np.flatnonzero(np.diff(records, prepend=~records[0]))
            links = np.diff(starts, append=len(records))
        records = records[starts]
        pairs, docs = records >> np.uint64(DOC_BITS), records & np.uint64((1 << DOC_BITS) - 1)
        radix = ((pairs >> np.uint64(B_BITS)) & np.uint64((1 << self.radix_bits) - 1)).astype(np.int64)
        order = np.argsort(radix, kind="stable")
        bounds = np.searchsorted(radix[order], np.arange((1 << self.radix_bits) + 1))
        for r in range(1 << self.radix_bits):
            of = order[bounds[r] : bounds[r + 1]]
            if len(of):
                starts = np.flatnonzero(np.diff(pairs[of], prepend=~pairs[of[0]]))
                counts = np.diff(starts, append=len(of))
                row = {"kind": [KEYS_ROW], "chunk": [self.number], "radix": [r], "keys": [run_bytes(pairs[of][starts], counts)],
                       "records": [packed(counts) + packed(docs[of]) + packed(links[of])]}
                yield _encoded(row, 1)


def _encoded(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in ENCODED], schema=ENCODED)


def align(docs: DataFrame, files: tuple[str, str, str, str], radix_bits: int = RADIX_BITS, chunk_records: int = CHUNK_RECORDS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    n_best counts links whose pair is as common as the commonest of its A id; count_sum sums the counts over
    links. ``files`` are the arguments of ``Tokenizers``. ``radix_bits``: the merge runs in 2^radix_bits independent parts; more for more chunks.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*files)
        number = TaskContext.get().partitionId() << 32
        chunk = Chunk(number, radix_bits)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for k in range(0, batch.num_rows, 100):
                texts = [t or "" for t in batch.column("text").slice(k, 100).to_pylist()]
                for doc_id, found in zip(ids[k : k + 100], both.encode(texts), strict=True):
                    chunk.add(doc_id, Aligned(both, *found) if found else None, both)
                    if chunk.size >= chunk_records or len(chunk.docs) >= CHUNK_DOCS:
                        yield from chunk.rows()
                        chunk = Chunk(chunk.number + 1, radix_bits)
        if chunk.docs:
            yield from chunk.rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spilled = None, Spilled()
        for batch in batches:
            for radix, chunk, keys in zip(*(batch.column(c).to_pylist() for c in ("radix", "chunk", "keys")), strict=True):
                if radix != current:
                    yield from _given_back(current, spilled)
                    current, spilled = radix, Spilled()
                spilled.add(chunk, keys)
        yield from _given_back(current, spilled)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, out = None, []
        names = ["kind", "chunk", "doc", "records", "given", *[n for n, _ in DOC_FIELDS]]
        for batch in batches:
            for kind, chunk, doc, records, given, *fields in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if totals is None or totals[0] != chunk:
                    totals = chunk, np.zeros((2, CHUNK_DOCS), np.int64)
                if kind == KEYS_ROW:
                    _add_contributions(totals[1], records, given)
                else:
                    out.append((*fields[:-1], int(totals[1][0, doc]), int(totals[1][1, doc]), fields[-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT_ARROW, strict=True)], schema=RESULT_ARROW)
                out = []

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, ENCODED_DDL)
    rows = stored(rows, "token_pairs")
    runs = rows.where(F.col("kind") == KEYS_ROW)
    by_radix = runs.select("radix", "chunk", "keys").repartition("radix").sortWithinPartitions("radix", "chunk")
    given = stored(by_radix.mapInArrow(merged, "radix int, chunk long, given binary"), "pair_counts")
    back = runs.select("kind", "chunk", "radix", "records").join(given, ["chunk", "radix"])
    empty = {n: F.lit(None).cast(t) for n, t in (("doc", "long"), ("records", "binary"), ("given", "binary"))}
    documents = rows.where(F.col("kind") == DOC_ROW).select("kind", "chunk", "radix", "doc", *[n for n, _ in DOC_FIELDS])
    everything = back.withColumn("doc", empty["doc"]).unionByName(
        documents.withColumns({"records": empty["records"], "given": empty["given"]}), allowMissingColumns=True
    )
    # a chunk's contributions first, then its documents
    return everything.repartition("chunk").sortWithinPartitions("chunk", "kind", "radix").mapInArrow(summed, RESULT)


def _given_back(radix: int | None, spilled: Spilled) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of one radix for every run: count * 2, plus 1 where it is its A id's highest."""
    if radix is None:
        spilled.close()
        return
    keys, counts = [], []
    for key, n in spilled.counts():
        keys.append(key)
        counts.append(n)
    pairs, totals = np.array(keys, np.uint64), np.array(counts, np.int64)
    del keys, counts
    # pairs come with the A side major: those of an A id stand together
    starts = np.flatnonzero(np.diff(pairs >> np.uint64(B_BITS), prepend=~pairs[0]))
    highest = np.repeat(np.maximum.reduceat(totals, starts), np.diff(starts, append=len(pairs)))
    coded = totals * 2 + (totals == highest)
    for number, (chunk, _, _) in enumerate(spilled.places):
        data = b"".join(packed(coded[np.searchsorted(pairs, run)]) for run, _ in spilled.frames(number))
        yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["radix", "chunk", "given"])
    spilled.close()


def _add_contributions(totals: np.ndarray, records: bytes, given: bytes) -> None:
    stream = io.BytesIO(records)
    counts, docs, links = (unpacked(stream).astype(np.int64) for _ in range(3))
    stream, parts = io.BytesIO(given), []
    while stream.tell() < len(given):
        parts.append(unpacked(stream).astype(np.int64))
    coded = np.repeat(np.concatenate(parts), counts)
    np.add.at(totals[0], docs, links * (coded & 1))
    np.add.at(totals[1], docs, links * (coded >> 1))
