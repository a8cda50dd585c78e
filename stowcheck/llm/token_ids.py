"""Token ids of documents as binary files: a PySpark Python data source, format ``token_ids``.

A file holds the ids of consecutive documents as Simple-8b words (``simple8b``), then the exceptions, the words
of each block, the ids and lengths of its documents, and a footer that says where each part lies. Files roll at
``max_file_ids``; a document lies in one file. A task writes hidden files. When all tasks have succeeded the
driver names them and writes ``_order``: the files in the order of partitions, each with its numbers of
documents and ids. So attempts of lost executors leave nothing that is read, and a reader knows where each file
starts in the stream of all ids without opening the others. Reading plans one partition per file, and
decodes the blocks of a few documents at a time.

``write_documents`` orders documents by (doc_id, hash of the text) in range partitions and encodes whole texts.
Defined results: a NULL or empty text has the end id only; NULL ids come first; repeated rows are repeated
documents; an empty table makes files without documents; other columns are not written. Paths may lie in any
file system that pyarrow reaches.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stowcheck.llm import simple8b
from stowcheck.llm.words import text_digest

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
MAGIC = b"TOKENS8B"
ORDER = "_order"
CODED_AT_ONCE = 1 << 19
END_ID = 1

# --- tokenizing -----------------------------------------------------------------------------------

_tokenizers: dict[str, WordTokenizer] = {}
_WORDS, _PIECES = 1_000_000, 300_000
_BYTES_AT_ONCE = 4 << 20


class WordTokenizer:
    """A tokenizer whose white space separates tokens and is dropped: words are encoded once and remembered.

    Its normalizer and its pattern work inside words, so the ids of a text are those of its words in turn. Words
    of plain characters, which the normalizer only lower-cases, are cut where its pattern cuts them, into letters,
    single digits and other signs. Such pieces are encoded many in one text, as each ends with a token that is
    marked as an end; a text whose ends don't match its pieces is encoded piece by piece. Ids are kept and
    returned as little-endian unsigned 32-bit integers.
    """

    # no quotes (the pattern knows contractions) and no < (special tokens start so)
    PLAIN = re.compile(r"[!-&(-;=-~\u00C0-\u00FF]+")
    # a space is a piece of its own, which stands between words
    PIECES = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[0-9]|[^ A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+| ")
    # stands in no ids, as these are below 2^24
    MARK = b"\xff\xff\xff\xff"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. Arrow cuts texts into words and puts the ids of equal words in their places."""
        # splits at the six ASCII white spaces only; one at an end of a text leaves an empty word, without ids
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        for known, most in ((self.words, _WORDS), (self.pieces, _PIECES)):
            if len(known) > most:
                known.clear()
        self._learn([w for w in words if w not in self.words])
        ids = pa.array(list(map(self.words.__getitem__, words)), pa.large_binary()).take(found.indices)
        _, ends, data = ids.buffers()
        if not len(ids):
            return [b""] * len(texts)
        ends = np.frombuffer(ends, np.int64)[ids.offset :][split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        whole = memoryview(data) if data else memoryview(b"")
        return [bytes(whole[i:j]) for i, j in pairwise(ends)]

    def _learn(self, words: list[str]) -> None:
        is_plain = list(map(self.PLAIN.fullmatch, words))
        other = [w for w, p in zip(words, is_plain, strict=True) if not p]
        words = [w for w, p in zip(words, is_plain, strict=True) if p]
        # pieces of all plain words in turn, a space between words
        found = self.PIECES.findall(" ".join(words).lower())
        pieces = list(set(found).difference(self.pieces, " "))
        for k in range(0, len(pieces), 5_000):
            part = pieces[k : k + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.pieces.update((p, data[cuts[i] : cuts[i + 1]]) for i, p in enumerate(part))
            else:
                self.pieces.update(zip(part, self._each(part), strict=True))
        if words:
            known = self.pieces
            coded = b"".join([known[p] if p != " " else self.MARK for p in found]).split(self.MARK)
            self.words.update(zip(words, coded, strict=True))
        self.words.update(zip(other, self._each(other), strict=True))

    def _each(self, texts: list[str]) -> Iterator[bytes]:
        for coded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", coded.ids).tobytes()


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in range partitions by (doc_id, hash of the text), and in that order in each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_digest(F.col("text")).alias("_digest"))
    ordered = rows.repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    return ordered.select("doc_id", "text")


def write_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, **options) -> None:
    """Ids of every text and the end id, in order of documents; texts are encoded by the tasks that write."""
    write_token_ids(in_order(docs), path, tokenizer=tokenizer_path, end_id=end_id, **options)


# --- files ----------------------------------------------------------------------------------------


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TokenFile:
    """Writes one file: ids are coded as they come; what is kept is bounded by ``max_file_ids``."""

    def __init__(self, stream):
        self.stream = stream
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_words = self.n_exceptions = 0
        self.per_block: list[np.ndarray] = []
        self.exceptions: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= CODED_AT_ONCE:
            self._code(self.n_waiting // simple8b.BLOCK * simple8b.BLOCK)

    def _code(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint64)
        words, per_block, exceptions = simple8b.encode(ids[:n], self.n_exceptions)
        self.stream.write(words.astype("<u8").tobytes())
        self.n_words += len(words)
        self.n_exceptions += len(exceptions)
        self.per_block.append(per_block)
        self.exceptions.append(exceptions)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._code(self.n_waiting)
        known = [d is not None for d in self.doc_ids]
        parts = {
            "exceptions": np.concatenate(self.exceptions).astype("<u8"),
            "per_block": np.concatenate(self.per_block).astype("<u4"),
            "doc_ids": np.array([d if d is not None else 0 for d in self.doc_ids], "<i8"),
            "known": np.array(known, np.uint8),
            "lengths": np.array(self.lengths, "<i8"),
        }
        at, places = len(MAGIC) + 8 * self.n_words, {}
        for name, part in parts.items():
            data = part.tobytes()
            self.stream.write(data)
            places[name] = [at, len(part)]
            at += len(data)
        footer = json.dumps({"words": self.n_words, "ids": self.n_ids, "parts": places}).encode()
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.stream.close()


def read_file(raw, start: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of every document of an open file whose first id is number ``start``."""
    size = raw.size()
    tail = raw.read_at(16, size - 16) if size >= 24 else b""
    if tail[8:] != MAGIC:
        raise ValueError("not a whole file of token ids")
    n = int.from_bytes(tail[:8], "little")
    footer = json.loads(raw.read_at(n, size - 16 - n))

    def part(name: str, kind: str) -> np.ndarray:
        at, count = footer["parts"][name]
        return np.frombuffer(raw.read_at(count * np.dtype(kind).itemsize, at), kind)

    exceptions, per_block = part("exceptions", "<u8"), part("per_block", "<u4").astype(np.int64)
    doc_ids, known, lengths = part("doc_ids", "<i8"), part("known", "u1"), part("lengths", "<i8")
    word_at = np.concatenate([[0], np.cumsum(per_block)])
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        begin = int(ends[first] - lengths[first])
        # as many documents as CODED_AT_ONCE ids hold, one at least
        last = max(first + 1, int(np.searchsorted(ends, begin + CODED_AT_ONCE, side="right")))
        until = int(ends[last - 1])
        b0, b1 = begin // simple8b.BLOCK, -(-until // simple8b.BLOCK)
        data = raw.read_at(int(word_at[b1] - word_at[b0]) * 8, len(MAGIC) + 8 * int(word_at[b0]))
        ids = simple8b.decode(np.frombuffer(data, "<u8"), exceptions)[begin - b0 * simple8b.BLOCK :]
        for d in range(first, last):
            at = int(ends[d] - lengths[d]) - begin
            yield int(doc_ids[d]) if known[d] else None, start + begin + at, ids[at : at + int(lengths[d])]
        first = last


@dataclass
class TokenCommit(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int, int]]


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_file_ids: int, tokenizer: str | None, end_id: int):
        self.path, self.max_file_ids = path, max_file_ids
        self.tokenizer, self.end_id = tokenizer, end_id

    def coded(self, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of a batch that has ids, or texts to encode."""
        doc_ids = batch.column("doc_id").to_pylist()
        if self.tokenizer is None:
            yield from zip(doc_ids, batch.column("ids").to_pylist(), strict=True)
            return
        tokenizer, end = word_tokenizer(self.tokenizer), array("I", [self.end_id]).tobytes()
        texts = pc.fill_null(batch.column("text"), "")
        # groups of about as many bytes, a long text with its group
        group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // _BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(doc_ids)]
        for i, j in pairwise(cuts):
            for doc_id, ids in zip(doc_ids[i:j], tokenizer.encode(texts.slice(i, j - i)), strict=True):
                yield doc_id, ids + end

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TokenCommit:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        files, out, name = [], None, ""

        def done() -> None:
            out.close()
            files.append((name, len(out.lengths), out.n_ids))

        for batch in iterator:
            for doc_id, ids in self.coded(batch):
                if out is None:
                    name = f".{uuid.uuid4().hex}.tokens"
                    out = TokenFile(system.open_output_stream(posixpath.join(path, name)))
                out.add(doc_id, np.frombuffer(ids or b"", "<u4"))
                if out.n_ids >= self.max_file_ids:
                    done()
                    out = None
        if out is not None:
            done()
        return TokenCommit(TaskContext.get().partitionId(), files)

    def commit(self, messages: list[TokenCommit | None]) -> None:
        """Names the files and writes their order: a line per file, ``_order`` last of all."""
        system, path = _open(self.path)
        lines = []
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, n_docs, n_ids in message.files:
                system.move(posixpath.join(path, name), posixpath.join(path, name.lstrip(".")))
                lines.append(json.dumps([name.lstrip("."), n_docs, n_ids]))
        system.create_dir(path, recursive=True)
        with system.open_output_stream(posixpath.join(path, ORDER)) as out:
            out.write("\n".join(lines).encode())

    def abort(self, messages: list[TokenCommit | None]) -> None:
        system, path = _open(self.path)
        for message in messages:
            for name, _, _ in message.files if message else []:
                system.delete_file(posixpath.join(path, name))


@dataclass
class TokenPart(InputPartition):
    name: str
    start: int


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.path)
        with system.open_input_file(posixpath.join(path, ORDER)) as raw:
            lines = raw.read().decode().splitlines()
        found, start = [], 0
        for name, _, n_ids in map(json.loads, lines):
            found.append(TokenPart(name, start))
            start += n_ids
        return found or [TokenPart("", 0)]

    def read(self, partition: TokenPart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = _open(self.path)
        with system.open_input_file(posixpath.join(path, partition.name)) as raw:
            rows, held = [], 0
            for doc_id, start, ids in read_file(raw, partition.start):
                rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                held += len(ids)
                if held >= CODED_AT_ONCE or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class TokenDataSource(DataSource):
    """Options: ``path``; for writing ``max_file_ids``, and ``tokenizer`` (its file) with ``end_id`` for rows with
    a text in place of ids."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(
            self.options["path"],
            int(self.options.get("max_file_ids", 32 << 20)),
            self.options.get("tokenizer"),
            int(self.options.get("end_id", END_ID)),
        )


def write_token_ids(coded: DataFrame, path: str, **options) -> None:
    """(doc_id, ids) rows, in the order of their partitions; ids are little-endian unsigned 32-bit integers.

    ``path`` must be new. NULL ids count as none.
    """
    coded.sparkSession.dataSource.register(TokenDataSource)
    coded.write.format("token_ids").mode("append").options(**options).save(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document with the number of ids before it, its number of ids and the ids."""
    spark.dataSource.register(TokenDataSource)
    return spark.read.format("token_ids").load(path)
