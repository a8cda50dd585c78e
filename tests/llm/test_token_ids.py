"""Simple-8b, and files of token ids, against the tokenizer itself on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowcheck.llm import queries, simple8b, token_ids
from stowcheck.llm.tables import ship_code

SF = "/root/testdata/sf0.001"
ODD = [(None, "a null id"), (900001, None), (900002, ""), (900003, " \t\n "), (900003, " \t\n "), (900004, "word " * 30_000),
       (-5, "negative"), (900005, "Ünï<|endoftext|>x ́y z ΑΣ é don't 'LL 日本語 🎉 \x00\x1c\x85"), (900006, "aΣ" * 20_000)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return base.union(spark.createDataFrame(ODD, base.schema)).withColumns({"ids": F.lit(1), "start": F.lit("x")}).repartition(3)


def expected(rows, tokenizer):
    """(doc_id, start, n_tokens, crc) by encoding whole texts in order."""
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return want


@pytest.mark.parametrize("high", [1, 2, 5, 300, 50_000, 1 << 33, (1 << 60) + 5, 1 << 63])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(high % 1000)
    for n in (0, 1, 7, simple8b.BLOCK - 1, simple8b.BLOCK, simple8b.BLOCK + 1, 5_000):
        values = rng.integers(0, high, n, np.uint64)
        repeated = np.repeat(values, rng.integers(1, 400, n))[:5_000]
        values[rng.random(n) < 0.05] = 2**64 - 1
        for v in (values, repeated):
            words, per_block, exceptions = simple8b.encode(v)
            assert len(words) == per_block.sum()
            assert (simple8b.decode(words, exceptions) == v).all()
            at = np.concatenate([[0], np.cumsum(per_block)])
            for b in range(len(per_block)):
                block = simple8b.decode(words[at[b] : at[b + 1]], exceptions)
                assert (block == v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def test_words_encoded_by_themselves_equal_whole_texts(tokenizer):
    path, rng = queries.tokenizer_file("word_bpe_49k.json"), random.Random(3)
    signs = "aZ09'<|> .,éÉ×÷ßªº́İıſﬁ日_-*\x1c\x85\u2028\xa0ǅ½²"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "don't", "'S x"]) for _ in range(2_000)]
    for text, ids in zip(texts, token_ids.WordTokenizer(path).encode(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_pack_their_selectors_share():
    assert len(simple8b.encode(np.ones(60, np.uint64))[0]) == 1
    assert len(simple8b.encode(np.full(1000, 40_000, np.uint64))[0]) == 1
    assert len(simple8b.encode(np.arange(32_768 - 600, 32_768, dtype=np.uint64))[0]) == 150


@pytest.mark.parametrize("max_file_ids", [1, 5_000, 1 << 25])
def test_files_read_back(spark, docs, tokenizer, tmp_path, max_file_ids):
    path = str(tmp_path / "tokens")
    small = docs.where("doc_id is null or doc_id % 10 < 3 or doc_id < 0")
    token_ids.write_documents(small, path, queries.tokenizer_file("word_bpe_49k.json"), max_file_ids=max_file_ids)
    got = token_ids.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    want = expected([(r.doc_id, r.text) for r in small.collect()], tokenizer)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    token_ids.write_documents(docs.where("false"), path, queries.tokenizer_file("word_bpe_49k.json"))
    assert token_ids.read_token_ids(spark, path).count() == 0


def test_cut_file_is_an_error(spark, docs, tmp_path):
    path = tmp_path / "cut"
    token_ids.write_documents(docs.limit(5), str(path), queries.tokenizer_file("word_bpe_49k.json"))
    for file in path.glob("*.tokens"):
        file.write_bytes(file.read_bytes()[:-3])
    with pytest.raises(Exception, match="not a whole file"):
        token_ids.read_token_ids(spark, str(path)).collect()


def test_registered_query(spark, tokenizer):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.registered()["op11_token_ids"](spark, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, tokenizer)
