"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct word shingles. Equal sets form a class, and only one representative of each
goes on. Banded signatures give buckets; their members are compared signature batch by signature batch, and
a pair is dropped as soon as the posterior probability of reaching the threshold falls below ``miss``.
Survivors are verified on their full sets. Components come from verified links alone.

No bucket is expanded into all its pairs. First every member meets the bucket's leader, which settles groups
of copies in one pass over them. Members that are then still outside the leader's component meet the rest of
the bucket in blocks of bounded size; a block hands on only pairs that may link different components, the
likeliest first. Members still outside after that meet the bucket once more, with full sets at hand, and every
remaining pair is verified in its block; only links leave it.

Defined results: NULL, empty and word-less texts have an empty set and are linked with nothing; a text with
fewer words than a shingle is one shingle; repeated rows form one class; a NULL id is never the smallest;
an empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.components import fresh_labels, joined_labels, scrambled
from stowcheck.llm.tables import stored
from stowcheck.llm.words import lower_words, mixed, text_digest, window_hashes, word_hashes

BLOCK = 512
# candidates of a member in a block that are verified by joining sets; all others are verified in the block
LIKELIEST = 4
# bands compared at a time
BATCH = 6


@dataclass(frozen=True)
class Plan:
    """Shingles, threshold (percent) and signature layout.

    The number of bands follows from ``unseen``, the chance that a pair just at the threshold shares no band;
    ``miss`` is the posterior bound below which a pair is dropped.
    """

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    unseen: float = 1e-4
    miss: float = 1e-6
    seed: int = 7

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.unseen) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.Generator(np.random.PCG64(self.seed))
        return tuple(draw.integers(0, 1 << 31, (2, self.size), np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1))

    def needed(self) -> list[int]:
        """Matches that a pair needs after each band to go on.

        With a uniform prior, P(similarity >= t | m of n match) is the chance of at most m successes in n + 1
        draws of probability t.
        """
        t, out = self.percent / 100, []
        for n in range(self.rows, self.size + 1, self.rows):
            total, m = 0.0, -1
            while total < self.miss and m < n:
                m += 1
                total += math.exp(
                    math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t)
                )
            out.append(m)
        return out

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = lower_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        return np.unique(window_hashes(word_hashes(words), min(self.shingle, len(words))))

    def signature(self, shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The least value of each permutation x -> factor * x + shift of 32-bit numbers."""
        least = np.full(self.size, np.iinfo(np.uint32).max, np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 512):
            part = x[at : at + 512, None] * factors[0]
            part += factors[1]
            np.minimum(least, part.min(axis=0), out=least)
        return least


def _sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    """rid, doc_id, text_key, n, class (two longs), signature and band hashes of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = plan.factors()
        places = np.arange(1, plan.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, c1, c2, sigs, bands = [], [], [], [], []
            for text in batch["text"].to_pylist():
                s = plan.shingles(text)
                n.append(len(s))
                if not len(s):
                    for column in (c1, c2, sigs, bands):
                        column.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                c1.append(int.from_bytes(digest[:8], "little", signed=True))
                c2.append(int.from_bytes(digest[8:], "little", signed=True))
                sig = plan.signature(s, factors)
                sigs.append(sig.tobytes())
                total = places.copy()
                for column in sig.reshape(plan.bands, plan.rows).T:
                    total = mixed(total + column)
                bands.append(total.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["rid"], batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()), pa.array(c1, pa.int64()),
                 pa.array(c2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["rid", "doc_id", "text_key", "n", "c1", "c2", "sig", "bands"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_digest(F.col("text")).alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"rid bigint, doc_id {kind}, text_key bigint, n bigint, c1 bigint, c2 bigint, sig binary, bands array<bigint>"
    return rows.mapInArrow(sketch, out)


def _pruned(pairs: DataFrame, sigs: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule them out."""
    needed = plan.needed()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["sig_a"].to_pylist()), np.uint32).reshape(-1, plan.bands, plan.rows)
            y = np.frombuffer(b"".join(batch["sig_b"].to_pylist()), np.uint32).reshape(-1, plan.bands, plan.rows)
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int32)
            for band, least in enumerate(needed):
                matches[alive] += (x[alive, band] == y[alive, band]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    one, two = sigs.toDF("a", "sig_a"), sigs.toDF("b", "sig_b")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                kept.append(_similar(x, y, plan))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(verify, "a bigint, b bigint")


def _similar(x: np.ndarray, y: np.ndarray, plan: Plan) -> bool:
    if 100 * min(len(x), len(y)) < plan.percent * max(len(x), len(y)):
        return False
    common = np.intersect1d(x, y, assume_unique=True).size
    return 100 * common >= plan.percent * (len(x) + len(y) - common)


def _open_pairs(members: DataFrame, labels: DataFrame, sigs: DataFrame, plan: Plan, sets: DataFrame | None = None) -> DataFrame:
    """Pairs of different components that may be links: of each member the likeliest in a block.

    With ``sets`` it is all those whose full sets reach the threshold, one for each component at most.
    ``members``: bucket, band, leader, rep. Members outside the leader's component meet all members of the
    bucket, in blocks of about BLOCK x BLOCK rows.
    """
    of_rep = labels.select(F.col("node").alias("rep"), F.col("label").alias("own"))
    of_leader = labels.select(F.col("node").alias("leader"), F.col("label").alias("led"))
    known = members.join(of_rep, "rep").join(of_leader, "leader").withColumn("open", (F.col("own") != F.col("led")).cast("int"))
    sizes = known.groupBy("bucket").agg(F.sum("open").alias("n_open"), F.count("*").alias("n_all")).where("n_open > 0")
    sizes = sizes.select(
        "bucket", F.ceil(F.col("n_open") / BLOCK).alias("open_blocks"), F.ceil(F.col("n_all") / BLOCK).alias("all_blocks")
    )
    known = known.join(sizes, "bucket").join(sigs.toDF("rep", "sig"), "rep")
    known = known.withColumn("set", F.lit(None).cast("binary")) if sets is None else known.join(sets.toDF("rep", "set"), "rep")
    mine, theirs = F.pmod(F.xxhash64("rep"), F.col("open_blocks")), F.pmod(F.xxhash64("rep"), F.col("all_blocks"))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    base = ["bucket", "band", "rep", "own", "open", "sig", "set"]
    one = known.where("open = 1").select(*base, mine.alias("i"), every("all_blocks").alias("j"), F.lit(0).alias("side"))
    two = known.select(*base, every("open_blocks").alias("i"), theirs.alias("j"), F.lit(1).alias("side"))
    block = ["bucket", "i", "j"]
    # groups are cut out of sorted rows: most have a few rows, too few to be worth a call each
    rows = one.union(two).repartition(*block).sortWithinPartitions(*block, "side", "rep")
    needed, verify = np.array(plan.needed(), np.int32), sets is not None

    def compare(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        n_open = int((block["side"].to_numpy() == 0).sum())
        ids, comps, opens = (block[c].to_numpy() for c in ("rep", "own", "open"))
        sigs = np.frombuffer(b"".join(block["sig"].to_pylist()), np.uint32).reshape(-1, plan.bands, plan.rows)
        band = block["band"][0].as_py()
        theirs, names, labels, is_open = sigs[n_open:], ids[n_open:], comps[n_open:], opens[n_open:]
        found_a, found_b = [], []
        full = [np.frombuffer(v.as_buffer(), np.uint64) for v in block["set"]] if verify else []
        for k in range(n_open):
            # a pair of two open members is met from the smaller one
            alive = np.flatnonzero((is_open == 0) | (names > ids[k]))
            matches = np.zeros(len(names), np.int32)
            for at in range(0, plan.bands, BATCH):
                if not len(alive):
                    break
                equal = (theirs[alive, at : at + BATCH] == sigs[k, at : at + BATCH]).sum(axis=2, dtype=np.int32)
                upto = matches[alive, None] + equal.cumsum(axis=1)
                matches[alive] = upto[:, -1]
                go_on = (upto >= needed[at : at + BATCH]).all(axis=1)
                # a pair that shares an earlier band is met there
                go_on &= ~(equal[:, : max(0, band - at)] == plan.rows).any(axis=1)
                alive = alive[go_on]
            alive = alive[np.lexsort((names[alive], -matches[alive]))]
            alive = alive[labels[alive] != comps[k]]
            if verify:
                alive = linked(alive, labels, full[k], full[n_open:])
            else:
                alive = alive[:LIKELIEST]
            found_a.append(np.full(len(alive), ids[k], np.int64))
            found_b.append(names[alive])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_a or none), np.concatenate(found_b or none)

    def linked(alive: np.ndarray, labels: np.ndarray, own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        met, kept = set(), []
        for i in alive.tolist():
            if labels[i] not in met and _similar(own, others[i], plan):
                met.add(labels[i])
                kept.append(i)
        return np.array(kept, np.int64)

    def compare_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([table[c].to_numpy() for c in block], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            found = [compare(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            rest = table.slice(cuts[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])
        if rest is not None and len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in compare(rest)], ["a", "b"])

    return rows.mapInArrow(compare_all, "a bigint, b bigint")


def _components(docs: DataFrame, plan: Plan, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_key, n_shingles, label, component_id of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(_sketch(docs, plan), "sketches")
    classes = rows.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("rid").alias("rep"))
    owned = rows.select("rid", "doc_id", "text_key", "n", "c1", "c2").join(classes, ["c1", "c2"], "left")
    owned = stored(owned.select("rid", "doc_id", "text_key", "n", "rep"), "classes")
    reps = owned.where("rid = rep").select("rid")

    bands = rows.select("rid", "bands").join(reps, "rid").select(F.col("rid").alias("rep"), F.posexplode("bands").alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).where("leader < _last")
    members = stored(bands.join(shared.drop("_last"), "bucket").select("bucket", "band", "leader", "rep"), "buckets")
    nodes = stored(members.select(F.col("rep").alias("node")).distinct(), "nodes")
    sigs = stored(rows.select("rid", "sig").join(nodes, rows["rid"] == nodes["node"]).select("rid", "sig"), "signatures")
    labels = stored(fresh_labels(nodes), "labels")

    wanted = owned.join(nodes, owned["rid"] == nodes["node"]).select("rid", F.col("doc_id").alias("_id"), "text_key")
    texts = docs.withColumn("text_key", text_digest(F.col("text")))
    texts = texts.join(wanted, (texts["text_key"] == wanted["text_key"]) & texts["doc_id"].eqNullSafe(wanted["_id"]))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [plan.shingles(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(sets, pa.binary())], ["rid", "set"])

    # a repeated row meets its class once for each copy
    sets = texts.select("rid", "text").dropDuplicates(["rid"]).mapInArrow(to_sets, "rid bigint, set binary")
    sets = stored(sets, "sets")

    to_leader = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(_verified(_pruned(to_leader, sigs, plan), sets, plan), "links")
    labels = joined_labels(labels, links)
    pairs = stored(_open_pairs(members, labels, sigs, plan).distinct(), "pairs")
    if not pairs.isEmpty():
        labels = joined_labels(labels, stored(_verified(pairs, sets, plan), "links"))
        # members without a candidate of another component meet nothing anew here
        labels = joined_labels(labels, stored(_open_pairs(members, labels, sigs, plan, sets).distinct(), "links"))

    labelled = owned.join(labels, owned["rep"] == labels["node"], "left")
    labelled = labelled.select("doc_id", "text_key", "n", F.coalesce("label", scrambled(F.coalesce("rep", "rid"))).alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = labelled.join(smallest, "label")
    return joined.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "label", "component_id")


def near_duplicates(docs: DataFrame, plan: Plan | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) of every row."""
    return _components(docs, plan or Plan(), text, doc_id).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, plan: Plan | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows that share a doc_id are told apart by their text; of rows that share both, one stays.
    """
    found = stored(_components(docs, plan or Plan(), text, doc_id), "components")
    rows = ["doc_id", "text_key"]
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min("text_key").alias("_kept"))
    is_kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("_kept"))
    gone = found.join(first, "label", "left").where(~F.coalesce(is_kept, F.lit(False)))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = text_digest(F.col(text))
    left = docs.join(gone, docs[doc_id].eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti")
    if found.groupBy(*rows).count().where("count > 1").isEmpty():
        return left
    return left.dropDuplicates([doc_id, text])
