"""Cross-tokenizer alignment against brute force that encodes with the tokenizers' own files."""

import collections
import hashlib
import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stowcheck.llm import align, pair_runs, queries
from stowcheck.llm.tables import ship_code

SF = "/root/testdata/sf0.001"
ODD = [(None, "a null id"), (900001, None), (900002, ""), (900003, " \t\n "), (900003, " \t\n "), (900004, "word " * 20_000),
       (900005, "Ünï<|endoftext|></s><unk> x ́y 日本語 🎉🎉 \x00\x1c\x85 ▁ ▁x"), (900006, "=" * 5_001 + "-" * 777 + " " * 999), (900007, "ab" * 30_000),
       (900008, "▁"), (900009, " " * 300_000 + "x" + "\n" * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return base.union(spark.createDataFrame(ODD, base.schema)).withColumns({"kind": F.lit("x"), "chunk": F.lit(1), "keys": F.lit(2)}).repartition(3)


def byte_level() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes with: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    as_byte = byte_level()

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    texts = []
    for doc_id, text in rows:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        spelled_a = [bytes(as_byte[c] for c in a_side.id_to_token(i)) for i in a]
        spelled_b = [b_bytes(i) for i in b]
        whole = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(spelled_a) == whole and b"".join(spelled_b) == whole:
            ends_a, ends_b = (list(itertools.accumulate(map(len, s))) for s in (spelled_a, spelled_b))
            cuts = sorted(set(ends_a) & set(ends_b))
            groups = [([], []) for _ in cuts]
            place = {e: g for g, (lo, hi) in enumerate(itertools.pairwise([0, *cuts])) for e in range(lo + 1, hi + 1)}
            for i, e in zip(a, ends_a, strict=True):
                groups[place[e]][0].append(i)
            for i, e in zip(b, ends_b, strict=True):
                groups[place[e]][1].append(i)
        links = collections.Counter()
        for x, y in groups:
            for i, n in collections.Counter(x).items():
                for j, m in collections.Counter(y).items():
                    links[i, j] += n * m
        texts.append((doc_id, groups, links))
    count = collections.Counter(pair for _, _, links in texts for pair in links)
    highest = collections.Counter()
    for (i, _), n in count.items():
        highest[i] = max(highest[i], n)
    out = []
    for doc_id, groups, links in texts:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def columns(df):
    rows = df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted(map(tuple, rows), key=str)


def test_runs_merge():
    rng = np.random.default_rng(1)
    want, spilled = collections.Counter(), pair_runs.Spilled()
    for owner in range(9):
        keys = np.unique(rng.integers(0, 1 << 62 if owner % 2 else 9_000, 6_000, np.uint64))
        counts = rng.integers(1, 1 << 40, len(keys))
        spilled.add(owner, pair_runs.run_bytes(keys, counts))
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert list(spilled.counts()) == sorted(want.items())
    spilled.close()


# few records to a chunk give many runs to merge
@pytest.mark.parametrize(("radix_bits", "chunk_records"), [(0, 2_000), (3, 20_000), (align.RADIX_BITS, align.CHUNK_RECORDS)])
def test_alignment_equals_brute_force(docs, radix_bits, chunk_records):
    got = columns(align.align(docs, queries.two_tokenizers(), radix_bits, chunk_records))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_wide_groups_count_like_others(monkeypatch, docs):
    both = align.tokenizers(*queries.two_tokenizers())
    for text in ("=" * 501, "word word", "ab" * 300):
        a, b = next(both.encode([text]))
        aligned = align.Aligned(both, a, b)
        sums = []
        for wide in (0, 1 << 60):
            monkeypatch.setattr(align, "WIDE_GROUP", wide)
            total = collections.Counter()
            for p, n in zip(*(x.tolist() for x in aligned.pairs()), strict=True):
                total[p] += n
            sums.append(total)
        assert sums[0] == sums[1] and sum(sums[0].values()) == aligned.n_links


def test_empty_table(docs):
    assert align.align(docs.where("false"), queries.two_tokenizers()).count() == 0


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert columns(queries.registered()["op12_tokenizer_alignment"](spark, SF)) == brute(rows)
