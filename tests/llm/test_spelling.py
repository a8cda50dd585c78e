"""Near words, forms and roots against brute force; the FM-index with few and with many words per half."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stowcheck.llm import queries, spelling
from stowcheck.llm.fm_index import Vocabulary
from stowcheck.llm.tables import ship_code

SF = "/root/testdata/sf0.001"
ODD = [(None, "Nullidentifier nullidentifier nullidentifer"), (900001, None), (900002, ""), (900003, "Straße STRAßEN×÷ ÀÉÎabcdefg ÀÉÎabcdefg"),
       (900003, "Straße STRAßEN×÷ ÀÉÎabcdefg ÀÉÎabcdefg"), (900004, "repetition " * 3_000 + "repetitio repetitio"), (900005, "a" * 3_000 + " " + "a" * 3_000),
       (900006, "a" * 3_001 + " " + "a" * 3_001), (900007, "日本語repetitions日本語 repetitions-repetitions")]


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(rows):
    counts = brute_counts(rows)
    # words that become equal by deleting one code point, or have it deleted, are all candidates
    by_deletion = collections.defaultdict(set)
    for w in counts:
        by_deletion[w].add(w)
        for i in range(len(w) if len(w) < 100 else 1):
            by_deletion[w[:i] + w[i + 1 :]].add(w)
    nearby = collections.defaultdict(set)
    for group in by_deletion.values():
        for a in group:
            nearby[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(nearby[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    want = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        want[w] = (form[w], root, n, len(nearby[w]), counts[form[w]] if form[w] else None)
    return want


@pytest.mark.parametrize("alphabet", ["ab", "abcdéÿ"])
def test_index_finds_all_words_one_error_away(alphabet):
    rng = random.Random(1)
    for size in (1, 2, 30, 300):
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(7, 9))) for _ in range(size)})
        asked = words + ["".join(rng.choice(alphabet + "z") for _ in range(rng.randint(6, 10))) for _ in range(40)]
        got = list(zip(*(x.tolist() for x in Vocabulary(words).one_error(asked)), strict=True))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if near(a, b)}


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return base.union(spark.createDataFrame(ODD, base.schema)).withColumns({"word": F.lit("x"), "n": F.lit(1)}).repartition(3)


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


# few words to a block split the halves that many words share into parts
@pytest.mark.parametrize("block_words", [10, spelling.BLOCK_WORDS])
def test_groups_equal_brute_force(docs, block_words):
    got = spelling.grouped(spelling.word_counts(docs, spelling.misspelled), block_words)
    assert got.count() == len(rows := result(got))
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_chain_of_forms(spark):
    ship_code(spark)
    chain = [("abcdefghij"[: 10 - k] + "z" * k, 10**k) for k in range(8)]
    got = result(spelling.grouped(spark.createDataFrame(chain, "word string, n long")))
    assert {got[w][1] for w, _ in chain} == {chain[-1][0]}
    assert got[chain[-1][0]][0] is None


def test_empty_table(docs):
    assert spelling.grouped(spelling.word_counts(docs.where("false"))).count() == 0


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert result(queries.registered()["op13_spelling_variants"](spark, SF)) == brute(rows)
