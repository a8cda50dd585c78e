"""The corpus pipeline against brute force, stage by stage, and held-out accuracy of the toxicity model."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stowcheck.llm import toxicity
from stowcheck.llm.tables import ship_code
from stowcheck.llm.words import lower_words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return NORMAL.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def good(text):
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    repeated = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    spoken = [line for line in text.split("\n") if WORD.search(line)]
    equal = len(spoken) - len(set(spoken))
    lines = sum(line.strip(" ") != "" for line in text.split("\n"))
    letters = sum(c.isalpha() for c in text)
    bad = (
        n < 10, 100 * len(repeated) > 20 * n, 10 * sum(c in "#*$%&|<>" for c in text) > n,
        equal >= 5 and 10 * equal > 4 * lines, 2 * len(re.findall("[A-Z]", text)) > chars,
        2 * len(re.findall("[!?]", text)) > n, chars < 2 * n, chars > 20 * n, 2 * letters < chars,
    )
    return not any(bad)


def without_repeats(docs):
    """docs: id -> text. Spoken lines left per document; those that lose all of them go."""
    lines = {i: [x for x in t.split("\n") if WORD.search(x)] for i, t in docs.items()}
    place, gone = {}, collections.defaultdict(set)
    for i in sorted(lines):
        for k in range(len(lines[i]) - 2):
            if place.setdefault(tuple(lines[i][k : k + 3]), (i, k)) != (i, k):
                gone[i] |= {k, k + 1, k + 2}
    return {i: [x for k, x in enumerate(v) if k not in gone[i]] for i, v in lines.items() if len(gone[i]) < len(v) or not v}


def first_of_each(words):
    """words: id -> list. The smallest id of every component of 5-word shingle sets of similarity 0.8 or more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def clean_words(text, windows):
    words = normal(text)
    hit = {j for i in range(len(words)) for n in windows for j in range(i, i + n) if tuple(words[i : i + n]) in windows[n]}
    return None if 2 * len(hit) > len(words) else [w for k, w in enumerate(words) if k not in hit]


def test_pipeline_equals_brute_force(spark, monkeypatch):
    kept, write = {}, corpus_pipeline.stored

    def recorded(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(corpus_pipeline, "stored", recorded)
    ship_code(spark)
    final = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)
    assert all(kept[n].columns == docs.columns for n in list(kept)[:-1])
    texts = {n: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for n, df in kept.items()}

    start = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts["quality_rules"]) == {i for i, t in start.items() if good(t or "")}
    assert all(texts["quality_rules"][i] == start[i] for i in texts["quality_rules"])

    lines = without_repeats(texts["quality_rules"])
    assert {i: [x for x in t.split("\n") if WORD.search(x)] for i, t in texts["line_dedup"].items()} == lines

    assert set(texts["near_duplicates"]) == first_of_each({i: lower_words(t) for i, t in texts["line_dedup"].items()})

    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = normal(r.text)
        n = min(10, len(words))
        windows[n] |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1 if n else 0)}
    windows.pop(0, None)
    cleaned = {i: clean_words(t, windows) for i, t in texts["near_duplicates"].items()}
    assert {i: normal(t) for i, t in texts["decontamination"].items()} == {i: w for i, w in cleaned.items() if w is not None}

    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in kept["decontamination"].collect():
        size = len(WORD.findall(r.text))
        sizes[r.source] += size
        largest[r.source] = max(largest[r.source], size)
    copies = collections.Counter()
    for r in final:
        assert r.text == texts["decontamination"][r.doc_id]
        taken[r.source] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2
    goal = 1.5 * sum(sizes.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    target, left = {}, set(sizes)
    while left:
        level = (goal - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} if full else {s: level * weight[s] for s in left}
        left = left - full if full else set()
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


@pytest.fixture(scope="module")
def labelled(spark):
    ship_code(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("toxic").alias("label"))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_ranks_held_out_documents(spark, labelled):
    docs, labels = labelled
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.fit(docs.join(learned, "doc_id"))
    truth = {r.doc_id: r.label for r in labels.collect()}
    scores = {r.doc.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores.values())
    bad = [scores[i] for i in truth if held_out(i) and truth[i] == 1]
    fine = [scores[i] for i in truth if held_out(i) and truth[i] == 0]
    assert bad and fine
    wins = sum((b > f) + 0.5 * (b == f) for b in bad for f in fine)
    assert wins / (len(bad) * len(fine)) > 0.85


def test_toxicity_of_odd_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs.join(labels, "doc_id"))
    rows = [(None, None), (1, None), (2, ""), (3, " .!\n"), (4, "word " * 20_000), (4, "word " * 20_000), (5, "A fine day.")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(7), "doc": F.lit(1)})
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc.doc_id in (1, 2, 3)} == {0.0}
    assert len({r.score for r in got if r.doc.doc_id == 4}) == 1
    assert toxicity.score(odd.where("false"), model).count() == 0
    nothing = toxicity.fit(docs.join(labels, "doc_id").where("false"))
    assert {round(r.score, 6) for r in toxicity.score(odd, nothing).collect()} == {0.0}
