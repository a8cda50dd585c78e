"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence's score is the logistic of the summed weights of its words
and of their beginnings (4 to 8 bytes), and the document's is their noisy-or: 1 - product of (1 - score). Weights are learned from document labels
alone, which also teaches which sentences offend.

The model is fitted on a bounded sample of labelled documents (``max_rows``): on the executors they become
numbers of features from a vocabulary of at most ``max_words``, and only those numbers reach the driver.

Defined results: NULL, empty and word-less texts have no sentence and score 0; labels other than 0 and 1 are
not used; without labels of both kinds every score is 0; repeated rows are scored alike; whole texts are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.decontaminate import normal_words

ENDS = re.compile(r"[.!?\n]+")
STEMS = range(4, 9)


def sentences(text: str | None) -> list[str]:
    return [s for s in ENDS.split(text or "") if s.strip()]


def grams(words: list[bytes]) -> set[bytes]:
    """The words, and their beginnings marked with ``^``; no word holds that mark."""
    found = set(words)
    for n in STEMS:
        found.update([b"^" + w[:n] for w in words if len(w) >= n])
    return found


@dataclass(frozen=True)
class ToxicModel:
    intercept: float = -30.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def sentence_scores(self, text: str | None) -> tuple[list[str], np.ndarray]:
        parts, get, z = [], self.weights.get, []
        for part in sentences(text):
            words = normal_words(part)
            if words:
                parts.append(part)
                z.append(sum([get(g, 0.0) for g in grams(words)]))
        z = np.clip(np.array(z, float) + self.intercept, -30, 30)
        return parts, 1 / (1 + np.exp(-z))


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-15)).sum()))


def _gram_counts(sample: DataFrame) -> DataFrame:
    """gram, n documents with it, k of them toxic; summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = Counter(), Counter()
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = grams(normal_words(text))
                n.update(found)
                if label:
                    k.update(found)
            names = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([k[g] for g in names], pa.int64())],
                ["gram", "n", "k"],
            )

    parts = sample.mapInArrow(count, "gram binary, n bigint, k bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def fit(
    labelled: DataFrame,
    text: str = "text",
    max_rows: int = 20_000,
    max_words: int = 2_000,
    min_errors: float = 5.0,
    epochs: int = 200,
    rate: float = 0.1,
    l1: float = 1e-4,
    store=lambda df: df,
) -> ToxicModel:
    """Fit on rows with ``text`` and ``label``: at most ``max_rows``, those of the smallest text hashes.

    The vocabulary holds the ``max_words`` grams whose share of toxic documents differs most from the mean, by
    ``min_errors`` standard errors or more, among grams of at least five documents.
    """
    known = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), F.col(text).alias("text"))
    sample = store(known.orderBy(F.xxhash64("text"), "label").limit(max_rows)).repartition(16)
    n, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or not toxic or toxic == n:
        return ToxicModel()
    share = toxic / n
    off = F.abs(F.col("k") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)))
    seen = _gram_counts(sample).where((F.col("n") >= 5) & (off >= min_errors))
    vocabulary = [bytes(r.gram) for r in seen.orderBy(off.desc(), "gram").limit(max_words).collect()]
    if not vocabulary:
        return ToxicModel()
    number = labelled.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, kind = number.value.get, pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            plain, known = [], []
            for text in batch["text"].to_pylist():
                bags = [grams(words) for s in sentences(text) if (words := normal_words(s))]
                bags = [[i for g in b if (i := get(g)) is not None] for b in bags]
                # sentences without a known gram are alike: their number is enough
                plain.append(sum(not b for b in bags))
                known.append([b for b in bags if b])
            yield pa.RecordBatch.from_arrays(
                [batch["label"], pa.array(plain, pa.int32()), pa.array(known, kind)], ["label", "plain", "bags"]
            )

    data = sample.mapInArrow(numbered, "label int, plain int, bags array<array<int>>").toArrow()
    labels, plain = data["label"].to_numpy(), data["plain"].to_numpy().astype(float)
    docs = data["bags"].to_pylist()
    doc_of = np.repeat(np.arange(n), [len(b) for b in docs])
    flat = [s for b in docs for s in b]
    sentence_of = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    word_of = np.fromiter((w for s in flat for w in s), np.int64, len(sentence_of))

    size = len(vocabulary)
    x, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    x[-1] = -6.0
    for step in range(1, epochs + 1):
        z = np.bincount(sentence_of, x[word_of], len(flat)) + x[-1]
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + math.exp(-x[-1]))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + plain * math.log1p(-min(p0, 1 - 1e-12))
        any_ = np.maximum(-np.expm1(none), 1e-12)
        # d loss / d z of a sentence is this factor times its score
        factor = np.where(labels == 1, -(1 - any_) / any_, 1.0)
        dz = factor[doc_of] * p
        slope = np.append(np.bincount(word_of, dz[sentence_of], size), dz.sum() + (factor * plain).sum() * p0) / n
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - rate * l1 / np.sqrt(v[:-1] / (1 - 0.999**step) + 1e-8), 0)
    return ToxicModel(float(x[-1]), {w: float(x[i]) for i, w in enumerate(vocabulary) if x[i]})


def score(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``doc`` (the whole row without the text), score and ``offending``: the sentences that score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, found = [], []
            for t in batch["text"].to_pylist():
                parts, each = own.sentence_scores(t)
                scores.append(noisy_or(each) if len(each) else 0.0)
                found.append([parts[i].strip() for i in np.flatnonzero(each >= 0.5)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["doc", "score", "offending"]
            )

    rest = F.struct(*[c for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_")])
    kind = docs.select(rest.alias("doc")).schema["doc"].dataType.simpleString()
    return docs.select(rest.alias("doc"), F.col(text).alias("text")).mapInArrow(
        run, f"doc {kind}, score double, offending array<string>"
    )
