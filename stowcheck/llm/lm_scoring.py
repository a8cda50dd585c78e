"""Language-model scoring by context-tree weighting over bytes.

A text is read as its words in lower case, one space between them and one line end after the last: exactly
the information in its tokens. Each byte is eight binary decisions; every decision is predicted in the
contexts of the last 0 to ``depth`` bytes by Krichevsky-Trofimov estimates. Bottom up, each node's block
probability is half its own estimate and half the product of its children's; top down, this gives the weight
with which a node's own estimate counts, and so one mixed probability per node. A context that training
hasn't seen is predicted by its longest seen suffix. log2 of the mixed probabilities is the code length.

Counting sums bytes in context and words in each task before the shuffle. The tree is built by one
aggregation (up) and one join (down) per depth. Documents are scored where they lie, against tables in slices
of at most ``max_nodes`` nodes and seen grams: positions are dealt to slices by their last two bytes, or by more
below a context that alone has a large part of a slice. Every slice has the nodes of contexts of fewer than two
bytes and of those so split, at most 255 a context and four split contexts a slice and byte. A slice's tables are
built by one task and written to one file in the shared folder; neither they nor the tree pass the driver.
Workers map the file, so those of one machine share one copy of the slice in use. With more than one slice, each
is a job of its own whose sums are stored. Word counts of the unigram base are broadcast for the ``max_head`` most
frequent words and joined for all others. The tables of the tree are dropped when the nodes have been stored.

Defined results: NULL, empty and word-less texts are the end token alone; repeated rows are scored alike,
and counted as often as they occur; without training rows every decision has probability 1/2 and no word is
known; an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.tables import drop_tables, open_path, stored
from stowcheck.llm.words import lower_words
from stowcheck.session import work_path

DEPTH = 5
END = b"\n"
CHUNK_BYTES = 1 << 18
FLUSH = 400_000
DEPTH_SHIFT = 56


def token_bytes(text: str | None) -> bytes:
    return b" ".join(lower_words(text)) + END


def grams(bodies: list[bytes], depth: int) -> np.ndarray:
    """Context and byte of every position, the byte lowest: a context's nearer bytes stand lower."""
    pad = END * depth
    data = np.frombuffer(b"".join([pad + b for b in bodies]), np.uint8)
    total = data.astype(np.uint64)
    for back in range(1, depth + 1):
        total[back:] |= data[:-back].astype(np.uint64) << np.uint64(8 * back)
    lengths = np.array([len(b) + depth for b in bodies])
    starts = np.cumsum(lengths) - lengths
    own = np.ones(len(data), bool)
    own[(starts[:, None] + np.arange(depth)).ravel()] = False
    return total[own]


def _chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Token bytes of the texts, in lists of about CHUNK_BYTES; texts are taken from the batch one by one."""
    part, size = [], 0
    for text in texts:
        part.append(token_bytes(text.as_py()))
        size += len(part[-1])
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counts(docs: DataFrame, depth: int) -> DataFrame:
    """gram, word, n: how often each gram (of bytes) and each token occurs; one of the two is NULL."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(names: list | None, codes: np.ndarray | None, n) -> pa.RecordBatch:
            size = len(n)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(size, pa.int64()) if codes is None else pa.array(codes.view(np.int64)),
                 pa.nulls(size, pa.binary()) if names is None else pa.array(names, pa.binary()), pa.array(n, pa.int64())],
                ["gram", "word", "n"],
            )

        words, parts, size = Counter(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

        for batch in batches:
            for bodies in _chunks(batch["text"]):
                for body in bodies:
                    words.update(body.split())
                words[END] += len(bodies)
                parts.append(np.unique(grams(bodies, depth), return_counts=True))
                size += len(parts[-1][0])
                if size > 4 * FLUSH:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > 2 * FLUSH:
                        yield rows(None, *parts[0])
                        parts, size = [], 0
                if len(words) > FLUSH:
                    yield rows(list(words), None, list(words.values()))
                    words = Counter()
        if parts:
            yield rows(None, *merged())
        if words:
            yield rows(list(words), None, list(words.values()))

    parts = docs.mapInArrow(count, "gram bigint, word binary, n bigint")
    return parts.groupBy("gram", "word").agg(F.sum("n").alias("n"))


def _lgamma(x: Column) -> Column:
    """Stirling's series at x + 8, stepped down by the recurrence."""
    y = x + 8
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - F.log(steps)


def _mask(depth: int) -> int:
    return (1 << (8 * (depth + 1))) - 1


def _tree(gram_counts: DataFrame, depth: int, scratch: list[str]) -> list[DataFrame]:
    """``scratch`` gets the paths of the tables it leaves. Per depth: node (context and the byte's bits so far, under a leading 1), q: mixed probability of a 1."""
    k, byte = F.col("k"), F.col("gram").bitwiseAND(255)
    right = lambda x, by: F.expr(f"shiftright({x}, {by})")
    bits = gram_counts.select("gram", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "n", "gram", "k", byte.cast("int").alias("byte")
    )
    prefix = right("byte", "8 - k").bitwiseOR(F.call_function("shiftleft", F.lit(1), k)).cast("long")
    node = F.col("gram").bitwiseAND(~255).bitwiseOR(prefix)
    bit = right("byte", "7 - k").bitwiseAND(1)
    n = F.col("n")
    level = bits.select(node.alias("node"), F.when(bit == 0, n).otherwise(0).alias("n0"), F.when(bit == 1, n).otherwise(0).alias("n1"))
    level = level.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def weighted(df: DataFrame, d: int) -> DataFrame:
        a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
        own = _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)
        df = df.select("*", own.alias("own"), ((b + 0.5) / (a + b + 1)).alias("p"))
        if d == depth:
            df = df.select("node", "n0", "n1", "p", F.col("own").alias("block"), F.lit(1.0).alias("stop"))
        else:
            high, low = F.greatest("own", "below"), F.least("own", "below")
            block = high + F.log1p(F.exp(low - high)) - math.log(2)
            df = df.withColumn("block", block)
            df = df.select("node", "n0", "n1", "p", "block", F.exp(F.col("own") - F.col("block") - math.log(2)).alias("stop"))
        return stored(df, f"tree_{d}", scratch)

    levels = {depth: weighted(level, depth)}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("node").bitwiseAND(_mask(d)).alias("node"))
        up = up.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("block").alias("below"))
        levels[d] = weighted(up, d)

    out = []
    for d in range(depth + 1):
        df = levels[d].select("node", "p", "stop")
        if d == 0:
            df = df.withColumns({"left": F.lit(1.0), "mixed": F.lit(0.0)})
        else:
            parents = out[-1].select(F.col("node").alias("_parent"), "left", "mixed")
            df = df.join(parents, df["node"].bitwiseAND(_mask(d - 1)) == parents["_parent"])
        share = F.col("left") * F.col("stop")
        df = df.select(
            "node",
            (F.col("mixed") + F.col("left") * F.col("p")).alias("q"),
            (F.col("left") - share).alias("left"),
            (F.col("mixed") + share * F.col("p")).alias("mixed"),
        )
        out.append(stored(df, f"mixed_{d}", scratch))
    return [df.select("node", "q") for df in out]


def _nodes(gram_counts: DataFrame, depth: int, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(code, value) of all nodes, with log odds of a 1, and of all seen grams, with log10 probability."""
    tree = _tree(gram_counts, depth, scratch)
    odds = F.log(F.col("q") / (1 - F.col("q")))
    nodes = [
        df.select(F.col("node").bitwiseOR(F.lit(d << DEPTH_SHIFT)).alias("code"), odds.cast("float").alias("value"), F.lit(d).alias("depth"))
        for d, df in enumerate(tree)
    ]
    every = nodes[0]
    for df in nodes[1:]:
        every = every.union(df)
    bits = gram_counts.select("gram", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), F.col("gram").bitwiseAND(255).cast("int").alias("byte"))
    prefix = F.expr("shiftright(byte, 8 - k)").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("long")
    bits = bits.select("gram", F.expr("shiftright(byte, 7 - k) & 1").alias("bit"), F.col("gram").bitwiseAND(~255).bitwiseOR(prefix).alias("node"))
    logs = bits.join(tree[depth], "node").groupBy("gram")
    logs = logs.agg(F.sum(F.log10(F.when(F.col("bit") == 1, F.col("q")).otherwise(1 - F.col("q")))).alias("value"))
    return every, logs.select(F.col("gram").alias("code"), F.col("value").cast("float").alias("value"))


class Table:
    """Open addressing over numpy arrays."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, slots: np.ndarray):
        self.codes, self.values, self.slots = codes, values, slots
        self.bits = len(slots).bit_length() - 1

    @classmethod
    def built(cls, codes: np.ndarray, values: np.ndarray) -> Table:
        table = cls(codes, values, np.full(1 << max(4, int(2 * len(codes)).bit_length()), -1, np.int32))
        left, at = np.arange(len(codes), dtype=np.int32), table._home(codes)
        while len(left):
            free = table.slots[at] < 0
            table.slots[at[free]] = left[free]
            lost = table.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << table.bits) - 1)
        return table

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Values of the codes, NaN where there is none."""
        out = np.full(len(codes), np.nan, np.float32)
        if not len(self.codes):
            return out
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.codes[slot] == codes[left])
            out[left[hit]] = self.values[slot[hit]]
            go_on = (slot >= 0) & ~hit
            left, at = left[go_on], (at[go_on] + 1) & ((1 << self.bits) - 1)
        return out


class SortedTable:
    """Binary search: slower than ``Table``, but nothing beside the codes and values is held."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values

    def find(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], np.float32(np.nan))


# --- slices in files of the shared folder ---------------------------------------------------------

# node codes, gram codes, slots of the grams' table, values of both
_KINDS = ("<u8", "<u8", "<i4", "<f4", "<f4")


def _write_slice(path: str, nodes: tuple[np.ndarray, np.ndarray], grams_: tuple[np.ndarray, np.ndarray]) -> None:
    table = Table.built(*grams_)
    arrays = (nodes[0], table.codes, table.slots, nodes[1], table.values)
    system, name = open_path(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(np.array([len(a) for a in arrays], "<i8").tobytes())
        for array, kind in zip(arrays, _KINDS, strict=True):
            out.write(np.ascontiguousarray(array, kind).tobytes())


_opened: dict[str, tuple[Table, SortedTable]] = {}


def _open_slice(path: str) -> tuple[Table, SortedTable]:
    """Tables of a slice, the last opened kept. Where the shared folder is mounted the file is mapped, so all
    workers of a machine share it in the page cache; from another store each worker reads it, once a slice."""
    if path not in _opened:
        _opened.clear()
        system, name = open_path(path)
        if isinstance(system, fs.LocalFileSystem):
            data = np.memmap(name, np.uint8, "r")
        else:
            with system.open_input_file(name) as raw:
                data = np.frombuffer(raw.read(), np.uint8)
        at, arrays = 8 * len(_KINDS), []
        for n, kind in zip(data[:at].view("<i8").tolist(), _KINDS, strict=True):
            size = n * np.dtype(kind).itemsize
            arrays.append(data[at : at + size].view(kind))
            at += size
        node_codes, gram_codes, slots, node_values, gram_values = arrays
        _opened[path] = Table(gram_codes, gram_values, slots), SortedTable(node_codes, node_values)
    return _opened[path]


def _written(rows: DataFrame, slices: int) -> list[tuple[str, int]]:
    """Path and number of rows of every slice's file, from ``rows`` (code, value, is_gram, slice; a NULL slice
    means all). A task builds the tables of one slice at a time; a repeated task writes files of other names."""
    folder = work_path(rows.sparkSession, "slices")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def close() -> pa.RecordBatch:
            path = f"{folder}/{current}-{uuid.uuid4().hex}"
            none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
            nodes, seen = (tuple(map(np.concatenate, zip(none, *part, strict=True))) for part in parts)
            _write_slice(path, nodes, seen)
            return pa.RecordBatch.from_pydict({"slice": [current], "path": [path], "n": [len(nodes[0]) + len(seen[0])]})

        for batch in batches:
            of = batch["slice"].to_numpy()
            bounds = np.flatnonzero(np.diff(of, prepend=of[0] - 1 if len(of) else 0))
            for lo, hi in zip(bounds, [*bounds[1:], len(of)], strict=True):
                if current is not None and of[lo] != current:
                    yield close()
                    parts = [[], []]
                current, part = int(of[lo]), batch.slice(lo, hi - lo)
                codes, values = part["code"].to_numpy().view(np.uint64), part["value"].to_numpy()
                is_gram = part["is_gram"].to_numpy(zero_copy_only=False)
                for flag in (False, True):
                    parts[flag].append((codes[is_gram == flag], values[is_gram == flag]))
        if current is not None:
            yield close()

    every = F.sequence(F.lit(0), F.lit(slices - 1))
    own = F.when(F.col("slice").isNull(), every).otherwise(F.array(F.col("slice").cast("int")))
    dealt = rows.select(F.explode(own).alias("slice"), "is_gram", "code", "value")
    dealt = dealt.repartition("slice").sortWithinPartitions("slice", "is_gram", "code")
    files = stored(dealt.mapInArrow(write, "slice long, path string, n long"), "slice_files")
    found = {r["slice"]: (r["path"], r["n"]) for r in files.collect()}
    return [found[i] if i in found else _empty_slice(folder, i) for i in range(slices)]


def _empty_slice(folder: str, i: int) -> tuple[str, int]:
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    _write_slice(f"{folder}/{i}", none, none)
    return f"{folder}/{i}", 0


class Model:
    """One slice of the tree. Seen grams are looked up by hash; the nodes serve unseen ones only."""

    def __init__(self, path: str, depth: int, slice_: int, slices: int, hot: list[list[int]]):
        self.path, self.depth, self.slice, self.slices, self.hot = path, depth, slice_, slices, hot

    def score(self, bodies: list[bytes]) -> np.ndarray:
        """log10 probability of each body's bytes that belong to this slice."""
        seen, nodes = _open_slice(self.path)
        codes = grams(bodies, self.depth)
        ends = np.cumsum([len(b) for b in bodies])
        own = np.ones(len(codes), bool)
        if self.slices > 1:
            own = slice_of(codes, self.slices, self.hot) == self.slice
        value = np.zeros(len(codes))
        value[own] = seen.find(codes[own])
        unseen = np.flatnonzero(np.isnan(value))
        if len(unseen):
            value[unseen] = self._by_bits(codes[unseen], nodes)
        total = np.concatenate(([0.0], np.cumsum(value)))
        return total[ends] - total[np.concatenate(([0], ends[:-1]))]

    def _by_bits(self, codes: np.ndarray, nodes: SortedTable) -> np.ndarray:
        context, byte = codes & ~np.uint64(255), codes & np.uint64(255)
        total = np.zeros(len(codes))
        for k in range(8):
            prefix = (byte >> np.uint64(8 - k)) | np.uint64(1 << k)
            odds, left = np.zeros(len(codes), np.float32), np.arange(len(codes))
            for d in range(self.depth, -1, -1):
                node = (context[left] | prefix[left]) & np.uint64(_mask(d))
                found = nodes.find(node | np.uint64(d << DEPTH_SHIFT))
                seen = ~np.isnan(found)
                odds[left[seen]] = found[seen]
                left = left[~seen]
                if not len(left):
                    break
            one = (byte >> np.uint64(7 - k)) & np.uint64(1)
            total -= np.logaddexp(0, np.where(one == 1, -odds, odds).astype(float)) / math.log(10)
        return total


def slice_of(codes: np.ndarray, slices: int, hot: list[list[int]]) -> np.ndarray:
    """Slices of codes without a depth; ``hot`` has the split contexts of two bytes, of three and so on."""
    context = codes >> np.uint64(8)
    key = context & np.uint64(0xFFFF)
    split = np.ones(len(codes), bool)
    for near, keys in enumerate(hot, 2):
        split &= np.isin(key, np.array(keys, np.uint64))
        key = np.where(split, context & np.uint64((1 << (8 * (near + 1))) - 1), key)
    return (key % np.uint64(65521) * np.uint64(40503) & np.uint64(0xFFFF)) % np.uint64(slices)


def _near(near: int) -> Column:
    """The last ``near`` bytes of a code's context."""
    return F.expr("shiftright(code, 8)").bitwiseAND((1 << (8 * near)) - 1)


def _slice_of(slices: int, hot: list[list[int]]) -> Column:
    """The slice of a row (code, depth) of the tables; NULL if every slice has it."""
    key = F.when(F.col("depth") >= 2 + len(hot), _near(2 + len(hot)))
    for near in range(1 + len(hot), 1, -1):
        own = F.when(F.col("depth") >= near, _near(near))
        key = F.when(_near(near).isin(hot[near - 2]), key).otherwise(own)
    return (key % 65521 * 40503).bitwiseAND(0xFFFF) % slices


def _dealing(every: DataFrame, depth: int, max_nodes: int) -> tuple[int, list[list[int]]]:
    """Slices and split contexts, so that at most ``max_nodes`` rows of ``every`` (code, depth) are dealt to a slice."""
    total = every.count()
    if total <= max_nodes:
        return 1, []
    hot, below = [], every
    for near in range(2, depth):
        sizes = below.where(F.col("depth") >= near).groupBy(_near(near).alias("near")).count()
        keys = [r["near"] for r in sizes.where(4 * F.col("count") > max_nodes).select("near").collect()]
        if not keys:
            break
        hot.append(keys)
        below = below.where(_near(near).isin(keys))
    slices = math.ceil(total / max_nodes)
    # dealing by hash is uneven
    while slices < 0xFFFF:
        sizes = every.groupBy(_slice_of(slices, hot).alias("slice")).count().where("slice IS NOT NULL")
        if (sizes.agg(F.max("count")).first()[0] or 0) <= max_nodes:
            break
        slices += max(1, slices // 4)
    return slices, hot


def _head_words(words: DataFrame, max_head: int) -> dict[bytes, int]:
    """Counts of the most frequent words: as many whole steps of frequency as ``max_head`` allows."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for at, size in sizes:
        total += size
        if total > max_head:
            break
        least = at
    if least is None:
        return {}
    found = words.where(step >= least).select("word", "n").toArrow()
    return dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))


def score(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    depth: int = DEPTH,
    max_nodes: int = 6_000_000,
    max_head: int = 200_000,
) -> DataFrame:
    """``doc`` (the row without its text), n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where ``training`` holds.
    """
    kept = F.struct(*[c for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_")])
    counts = stored(_counts(docs.where(training).select(F.col(text).alias("text")), depth), "counts")
    words, gram_counts = counts.where("word IS NOT NULL").select("word", "n"), counts.where("gram IS NOT NULL").select("gram", "n")
    tokens, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scratch: list[str] = []
    nodes, logs = _nodes(gram_counts, depth, scratch)
    nodes, logs = stored(nodes, "nodes"), stored(logs, "grams")
    drop_tables(scratch)
    context = docs.sparkSession.sparkContext

    divisor = tokens + 0.5 * (known + 1)
    head = context.broadcast(_head_words(words, max_head))
    logs = logs.withColumn("depth", F.lit(depth))
    slices, hot = _dealing(nodes.select("code", "depth").unionByName(logs.select("code", "depth")), depth, max_nodes)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (word NULL) with what the head words give, and rows of their other words."""
        logs_of = {w: math.log10((n + 0.5) / divisor) for w, n in head.value.items()}
        get = logs_of.get
        for batch in batches:
            rids, tails, base, n_tokens, n_known = [], [], [], [], []
            for rid, t in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = [*lower_words(t), END]
                values = [get(w) for w in found]
                seen = [v for v in values if v is not None]
                base.append(math.fsum(seen))
                n_tokens.append(len(found))
                n_known.append(len(seen))
                if len(seen) < len(found):
                    for w, n in Counter(w for w, v in zip(found, values, strict=True) if v is None).items():
                        rids.append(rid)
                        tails.append((w, n))
            size, rest = batch.num_rows, len(rids)
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], batch["doc"], pa.nulls(size, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base)],
                names,
            )
            if rest:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids, pa.int64()), pa.nulls(rest, batch["doc"].type), pa.array([w for w, _ in tails], pa.binary()),
                     pa.array([n for _, n in tails], pa.int64()), pa.array([0] * rest, pa.int64()), pa.array([0.0] * rest)],
                    names,
                )

    names = ["rid", "doc", "word", "n_tokens", "n_known", "value"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), kept.alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    if slices > 1:
        # the row numbers of every pass
        rows = stored(rows, "texts")
    every = nodes.withColumn("is_gram", F.lit(False)).unionByName(logs.withColumn("is_gram", F.lit(True)))
    files = _written(every.withColumn("slice", _slice_of(slices, hot) if slices > 1 else F.lit(0)), slices)
    models, parts = [Model(path, depth, i, slices, hot) for i, (path, _) in enumerate(files)], []
    if slices > 1:
        parts = [stored(_slice_scores(rows.select("rid", "text"), model), f"slice_{model.slice}") for model in models]
    # texts go no further: the scores are stored with the row numbers of this very pass
    split_rows = rows.mapInArrow(_with_scores(split, None if parts else models[0]), f"rid bigint, doc {kind}, word binary, n_tokens bigint, n_known bigint, value double, score double")
    split_rows = stored(split_rows, "scored")

    tail = split_rows.where("word IS NOT NULL").select("rid", "word", F.col("n_tokens").alias("times"))
    tail = tail.join(words, "word", "left")
    each = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(divisor))
    tail = tail.groupBy("rid").agg(
        F.sum(F.col("times") * each).alias("_value"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known")
    )
    done = split_rows.where("word IS NULL").join(tail, "rid", "left")
    if parts:
        total = reduce(DataFrame.union, parts).groupBy("rid").agg(F.sum("value").alias("score"))
        done = done.drop("score").join(total, "rid")
    return done.select(
        "doc",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("value") + F.coalesce("_value", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _slice_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(rid, value) of ``rows`` (rid, text): log10 probabilities of the bytes that belong to the model's slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(_scores_of(model, batch))], ["rid", "value"])

    return rows.mapInArrow(run, "rid bigint, value double")


def _scores_of(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[model.score(bodies) for bodies in _chunks(batch["text"])]])


def _with_scores(split, model: Model | None):
    """``split`` with a score beside each document: the model's if there is one, else 0; other rows have 0.

    Scoring and splitting share a pass, and so the workers of a core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = np.zeros(0)

        def pieces() -> Iterator[pa.RecordBatch]:
            nonlocal scores
            for whole in batches:
                for k in range(0, whole.num_rows, 1_000):
                    batch = whole.slice(k, 1_000)
                    scores = _scores_of(model, batch) if model else np.zeros(batch.num_rows)
                    yield batch

        # what split makes of a piece comes before it takes the next
        for out in split(pieces()):
            plain = out["word"].null_count == out.num_rows
            score = pa.array(scores) if plain else pa.array([0.0] * out.num_rows)
            yield pa.RecordBatch.from_arrays([*out.columns, score], [*out.schema.names, "score"])

    return run
