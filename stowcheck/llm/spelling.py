"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped under the common form.

Words are the maximal runs of Latin letters with A-Z in lower case, counted over all texts. Two near words share
the first or the last half of the query exactly, so a word is looked for only among words with the same half:
the vocabulary is dealt by half, both as what is indexed and as queries, many halves to a block. Each block
builds a bidirectional FM-index of its words and searches it (``fm_index``). A half with more words than a block
may hold is split: its words are dealt to several parts, and each part of the queries meets each part of the index.

Counts are summed per task, links are aggregated per word, and forms are followed by doubling joins; nothing is
collected. Defined results: a NULL text has no words, a NULL id counts as empty text where ids matter; repeated
rows count again; of near words of equal count the smallest in code-point order is the form; an empty table has
no words; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.fm_index import Vocabulary
from stowcheck.llm.tables import stored
from stowcheck.llm.words import LOWER

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 7, 2, 10
BLOCK_WORDS = 30_000
LONGEST_HALF = 12
_COUNTED_AT_ONCE = 300_000

Change = Callable[[str, str], str]


def misspelled(doc_id: str, run: str, every: int = 31) -> str:
    """A run without one of its code points, in one of ``every`` cases that a hash of id and run decides."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, change: Change | None = None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all texts; ``change`` turns a document's id and a run into the word it counts as.

    ``change`` may shorten a run, but not lengthen it.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                runs = Counter(RUN.findall((text or "").encode().translate(LOWER).decode()))
                for run, n in runs.items():
                    if len(run) >= min_length:
                        word = change(doc_id, run) if change else run
                        if len(word) >= min_length:
                            total[word] += n
                if len(total) >= _COUNTED_AT_ONCE:
                    yield _counts(total)
                    total.clear()
        if total:
            yield _counts(total)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    found = rows.mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def _halves(word: Column, length: Column) -> Column:
    """(side, half) of a query of ``length`` code points: what a near word has too, at its start or its end."""
    first = F.least(F.floor(length / 2), F.lit(LONGEST_HALF)).cast("int")
    second = F.least(length - F.floor(length / 2), F.lit(LONGEST_HALF)).cast("int")
    return F.array(
        F.struct(F.lit("first").alias("side"), F.left(word, first).alias("half")),
        F.struct(F.lit("last").alias("side"), F.right(word, second).alias("half")),
    )


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, near, near_n): every pair of near words, in both directions, once each. Words are distinct.

    A word is a query under its own two halves, and indexed under those of queries one shorter to one longer.
    """
    length = F.length("word")
    indexed = F.array_distinct(F.flatten(F.transform(F.array(length - 1, length, length + 1), lambda n: _halves(F.col("word"), n))))
    asked = _halves(F.col("word"), length)
    rows = stored(
        words.select("word", "n", asked.alias("asked"), F.explode(indexed).alias("key"))
        .select("word", "n", "key.*", F.array_contains("asked", F.col("key")).alias("is_query")),
        "halves",
    )
    groups = rows.groupBy("side", "half").agg(F.count("*").alias("rows"))
    # parts of a half: 1, unless it has more words than a block
    large = stored(groups.where(F.col("rows") > block_words).select("side", "half", F.ceil(F.col("rows") / block_words).alias("parts")), "large_halves")
    session = rows.sparkSession
    packs = max(2 * session.sparkContext.defaultParallelism, rows.count() // block_words + 1)
    dealt = rows.join(large, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    part = F.pmod(F.xxhash64(F.lit(2), "word"), F.col("parts"))
    # (part of the index, part of the queries): an indexed row goes to its part of the index under all parts of
    # queries, a query to its part of the queries under all parts of the index
    as_indexed = F.transform(every, lambda q: F.struct(part.alias("index_part"), q.alias("query_part"), F.lit(True).alias("in_index")))
    as_query = F.transform(every, lambda i: F.struct(i.alias("index_part"), part.alias("query_part"), F.lit(False).alias("in_index")))
    both = F.concat(as_indexed, F.when(F.col("is_query"), as_query).otherwise(F.array()))
    pack = F.pmod(F.xxhash64(F.lit(3), "side", "half"), F.lit(packs))
    own = F.when(F.col("parts") > 1, F.concat("side", F.lit(":"), "half"))
    blocks = dealt.select("word", "n", pack.alias("pack"), own.alias("own"), F.explode(both).alias("as"))
    blocks = blocks.select("word", "n", "pack", "own", "as.*")

    def searched(block: pa.Table) -> pa.Table:
        index, queries = {}, set()
        for word, n, in_index in zip(*(block.column(c).to_pylist() for c in ("word", "n", "in_index")), strict=True):
            if in_index:
                index[word] = n
            else:
                queries.add(word)
        known, asked = list(index), list(queries)
        links = Vocabulary(known).one_error(asked) if known and asked else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        near = [known[w] for w in links[1].tolist()]
        columns = [[asked[q] for q in links[0].tolist()], near, [index[w] for w in near]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    links = blocks.groupBy("pack", "own", "index_part", "query_part").applyInArrow(searched, "word string, near string, near_n long")
    return links.distinct()


def grouped(words: DataFrame, block_words: int = BLOCK_WORDS, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    A word's form is its near word of largest count, if that is ``factor`` times its own or more; its root is
    the last form of the chain. Counts grow along a chain, so it ends.
    """
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("by"), F.col("near").alias("near")))
    links = near_words(words, block_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has_form = -F.col("best.by") >= factor * F.col("n")
    found = words.join(links, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.by")).alias("form_n"),
    )
    found = stored(found, "forms")
    roots = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    return found.join(_followed(stored(roots, "roots")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _followed(roots: DataFrame) -> DataFrame:
    """``roots`` (word, root) with every root that has one itself replaced by it, until none has."""
    while True:
        next_root = roots.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = roots.join(next_root, roots["root"] == next_root["_word"], "left")
        moved = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return roots
