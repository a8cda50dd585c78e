"""Runs of sorted keys in zstd frames, and their merge by a heap.

A run holds ascending unsigned 64-bit keys, each with a count. It is stored in frames of FRAME keys, keys as
differences, so a merge holds one frame of each run. Runs that arrive at a merge are spilled to a file of the
task; the file has no name and goes when it is closed.
"""

from __future__ import annotations

import heapq
import io
import tempfile
from collections.abc import Iterator

import numpy as np
import zstandard

FRAME = 4096


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as a zstd frame of the smallest type that holds them."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    data = zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())
    return bytes([kind.itemsize]) + len(data).to_bytes(4, "little") + data


def unpacked(stream) -> np.ndarray:
    size = stream.read(1)[0]
    data = stream.read(int.from_bytes(stream.read(4), "little"))
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), f"<u{size}")


def run_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    out = io.BytesIO()
    out.write((-(-len(keys) // FRAME)).to_bytes(4, "little"))
    for k in range(0, len(keys), FRAME):
        part = keys[k : k + FRAME]
        out.write(int(part[0]).to_bytes(8, "little") + packed(np.diff(part)) + packed(counts[k : k + FRAME]))
    return out.getvalue()


def run_frames(data) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) frame by frame; ``data`` is bytes or an open stream at the start of a run."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    for _ in range(int.from_bytes(stream.read(4), "little")):
        first = np.uint64(int.from_bytes(stream.read(8), "little"))
        steps, counts = unpacked(stream).astype(np.uint64), unpacked(stream).astype(np.int64)
        yield np.concatenate([[first], first + np.cumsum(steps, dtype=np.uint64)]), counts


class Spilled:
    """Runs in one unnamed file of the task."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(prefix="runs-")
        self.places: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, owner: int, data: bytes) -> None:
        self.file.write(data)
        self.places.append((owner, self.size, len(data)))
        self.size += len(data)

    def frames(self, number: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Frames of a run, each read when it is wanted."""
        _, at, length = self.places[number]
        yield from run_frames(_Part(self.file, at, length))

    def counts(self) -> Iterator[tuple[int, int]]:
        """(key, sum of its counts over all runs), by ascending key: a k-way merge on a heap."""

        def entries(number: int) -> Iterator[tuple[int, int]]:
            for keys, counts in self.frames(number):
                yield from zip(keys.tolist(), counts.tolist(), strict=True)

        key, total = None, 0
        for k, n in heapq.merge(*map(entries, range(len(self.places)))):
            if k != key:
                if key is not None:
                    yield key, total
                key, total = k, 0
            total += n
        if key is not None:
            yield key, total

    def close(self) -> None:
        self.file.close()


class _Part:
    """A part of a shared file with a place of its own."""

    def __init__(self, file, at: int, length: int):
        self.file, self.at, self.end = file, at, at + length

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(min(n, self.end - self.at))
        self.at += len(data)
        return data
