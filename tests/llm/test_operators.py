"""Operators of stowcheck.llm against brute force on small tables, with nulls, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowcheck.llm import decontaminate, line_dedup, lm_scoring, minhash, mixing, quality, substring_dedup, url_filter, warc
from stowcheck.llm.lm_scoring import score
from stowcheck.llm.tables import ship_code
from stowcheck.llm.words import lower_words, mixed, window_hashes

SF = "/root/testdata/sf0.001"
ODD = [(None, "a null id with some words in it", None, "x"), (900001, None, "en", None), (900002, "", "en", "s"),
       (900003, " \t\n ", None, "s"), (900003, " \t\n ", None, "s"), (900004, "word " * 30_000, "en", "s"), (900005, "word", "en", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    ship_code(spark)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(ODD, base.schema)
    # names that operators use themselves
    return base.union(odd).withColumns({"n_words": F.lit(1), "label": F.lit(2), "row": F.lit(3)}).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def test_empty_tables(docs):
    none = docs.where("false")
    assert quality.quality(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert mixing.mix(none).count() == 0


def test_quality_measures(docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in quality.quality(docs).collect():
        text = r.doc.text or ""
        words = word.findall(text)
        windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [line for line in text.split("\n") if word.search(line)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        assert r.base_failed == failed and not (failed and r.kept)


def components(rows, shingle, percent):
    def shingles(text):
        words = lower_words(text)
        return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()

    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[find(i)].append(r.doc_id)
    return sorted((str(r.doc_id), len(sets[i]), min(ids[find(i)], default=None)) for i, r in enumerate(rows))


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, shingle, percent):
    found = minhash.near_duplicates(docs, minhash.Plan(shingle=shingle, percent=percent))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in found.collect())
    assert got == components(rows, shingle, percent)


def test_one_of_each_keeps_columns_and_one_row_per_component(docs, rows):
    kept = minhash.one_of_each(docs, minhash.Plan())
    assert kept.columns == docs.columns
    want = {(i, c) for i, _, c in components(rows, 5, 80) if i == str(c)}
    got = collections.Counter(str(r.doc_id) for r in kept.collect())
    assert {i for i, _ in want} <= set(got) and max(got.values()) == 1


def test_line_dedup(docs, rows):
    place, gone = {}, collections.defaultdict(set)
    lines = {r.doc_id: [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for r in rows}
    for i in sorted(lines, key=lambda i: (i is None, i)):
        for k in range(len(lines[i]) - 2):
            if place.setdefault(tuple(lines[i][k : k + 3]), (i, k)) != (i, k):
                gone[i] |= {k, k + 1, k + 2}
    for r in line_dedup.dedup_lines(docs).collect():
        i = r.doc.doc_id
        assert (r.n_lines, r.n_removed) == (len(lines[i]), len(gone[i]))
        left = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert left == [x for k, x in enumerate(lines[i]) if k not in gone[i]]
        assert gone[i] or r.text == r.doc.text


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "Red green BLUE"), (2, None), (None, "one two three four five six seven eight nine ten eleven"), (1, "Red green BLUE")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "x red, GREEN blue y"), (2, "zero one two three four five six seven eight nine ten twelve"), (3, None), (4, "clean")], "doc_id long, text string")
    for limit in (1_000_000, 3):
        found = {r.row.doc_id: r.found for r in decontaminate.scan(texts, items, max_windows=limit).collect()}
        assert [(s["first"], s["last"]) for s in found[1]["spans"]] == [(1, 3)] and found[1]["items"] == ["1"]
        assert [(s["first"], s["last"]) for s in found[2]["spans"]] == [(1, 10)] and found[3]["n_words"] == 0 and not found[4]["spans"]
    cleaned = {r.doc_id: r.text for r in decontaminate.remove_spans(texts, items, max_hit_share=1.0).collect()}
    assert cleaned == {1: "x  y", 2: "zero  twelve", 3: None, 4: "clean"}
    assert decontaminate.remove_spans(docs, items).columns == docs.columns


def test_url_rules(spark):
    urls = ["http://a.example.org/es/1?q", "HTTPS://Example.ORG/en/17#x", "x://shop.com/de/", "ftp://b.net/es", "no url", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    model = url_filter.train(url_filter.labelled_by_rules(df), dimension=64, steps=2)
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, model).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/17", "example.org/en/1", "block")
    assert got[2] == ("shop.com", "/de/", "com/de/", "block")
    assert got[3][:3] == ("b.net", "/es", None) and got[4][:3] == ("", "", None) == got[5][:3]


def test_url_model_learns(spark):
    rows = [(f"{'casino' if i % 2 else 'library'}{i}.net", f"/{i}", i % 2) for i in range(60)]
    model = url_filter.train(spark.createDataFrame(rows, "host string, path string, label int"), dimension=512)
    scored = spark.createDataFrame([("casino999.net", "/x"), ("library999.net", "/x")], "host string, path string")
    bad, good = (r[0] for r in scored.select(model.score(F.col("host"), F.col("path"))).collect())
    assert bad > 0.5 > good


def test_mixing(docs, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(lower_words(r.text))
    got = mixing.mix(docs).collect()
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, dict.fromkeys(names)
    while left:
        share = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if share * weight[s] >= 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in full} or {s: share * weight[s] for s in left}
        left = {s: None for s in left if s in full and False or s not in target}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.doc.source]) and r.source_size == sizes[r.doc.source] and r.copies <= 2
        taken[r.doc.source] += r.copies * r.size
    largest = max(r.size for r in got if r.size < 30_000)
    assert all(abs(taken[s] - target[s]) <= largest for s in names if s != "s")


def test_warc_round_trip(spark, tmp_path):
    rows = [("response", "<a>", "http://x/\r\né %41", b"body" * 50, {"X-A": "1"}), ("response", "<b>", None, None, {}), ("revisit", "<c>", "u", None, {"X-B": " z"})]
    df = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, payload binary, headers map<string,string>")
    warc.write_warc(df.repartition(2), str(tmp_path), max_file_bytes=200)
    got = {r.record_id: (r.record_type, r.target_uri, r.payload and bytes(r.payload), dict(r.headers)) for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got["<a>"][:3] == rows[0][0:1] + rows[0][2:4] and got["<a>"][3]["X-A"] == "1"
    assert got["<b>"][:3] == ("response", None, b"") and got["<c>"][:3] == ("revisit", "u", None)
    only = warc.read_warc(spark, str(tmp_path), payload=False).where("record_type = 'response'")
    assert sorted(r.record_id for r in only.collect()) == ["<a>", "<b>"] and all(r.payload is None for r in only.collect())


def test_fuzzy_passages(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(900)]
    passage = words[:70]
    fuzzy = passage[:30] + ["other"] + passage[31:50] + passage[52:]
    texts = [words[100:200] + passage + words[200:300], words[300:420] + fuzzy + words[420:500], words[500:800], words[500:800], words[800:840]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in substring_dedup.repeated_passages(df).collect())
    assert [g[:2] for g in got] == [(1, 0), (3, 2)]
    assert got[0][2:6] == (120, 187, 100, 169) and got[0][6] == 67 and got[1][2:4] == (0, 299)
    cut = {r.doc_id: r.text.split() for r in substring_dedup.without_passages(df).collect()}
    assert cut[1] == words[300:500] and cut[0] == texts[0] and cut[3] == []


def test_passages_whose_parts_stand_alone_before(spark):
    draw = iter(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(20_000))
    new = lambda n: [next(draw) for _ in range(n)]
    texts, wanted = [], {}
    for size, count in [(20, 3)] * 6 + [(30, 2)] * 6 + [(35, 2)] * 6:
        parts = [new(size) for _ in range(count)]
        texts += [new(50) + part + new(50) for part in parts]
        passage = sum(parts, [])
        # the first text that has the passage has a part of it alone before
        texts += [new(30) + parts[-1] + new(30) + passage + new(30), new(40) + passage + new(40)]
        wanted[len(texts) - 1] = (len(texts) - 2, 40, 39 + size * count, 60 + size, 59 + size + size * count, size * count)
    # no seeds but those of ever other texts: each 39 words of the passage stand alone in one of them
    passage = new(60)
    texts += [new(20) + passage[i : i + 39] + new(20) for i in range(22)]
    texts += [new(20) + passage + new(20), new(10) + passage + new(20)]
    wanted[len(texts) - 1] = (len(texts) - 2, 10, 69, 20, 79, 60)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {}
    for r in substring_dedup.repeated_passages(df).collect():
        got.setdefault(r[0], []).append(tuple(r)[1:])
    assert {i: got.get(i) for i in wanted} == {i: [w] for i, w in wanted.items()}


def test_passages_below_changed_ones_of_another_text(spark):
    draw = iter(hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(20_000))
    new = lambda n: [next(draw) for _ in range(n)]
    texts, wanted = [], set()
    for at in (230, 250, 270):
        first = new(500)
        # the last text has the first with one word changed; a part with that word is in the one between
        copy = [*first[:at], *new(1), *first[at + 1 :]]
        n = len(texts)
        texts += [first, new(30) + copy[150:350] + new(30), copy]
        wanted |= {(n + 2, n + 1, at), (n + 2, n, at), (n + 1, n, at - 120)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = substring_dedup.repeated_passages(df).collect()
    assert wanted == {w for w in wanted if any(r[:2] == w[:2] and r["first"] <= w[2] - 39 and w[2] + 39 <= r["last"] for r in got)}


def test_passages_meet_the_first_text_that_has_them(spark):
    vocabulary = [hashlib.md5(str(i).encode()).hexdigest()[:5] for i in range(4000)]
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        text = draw.choices(vocabulary, k=60)
        for old in draw.sample(texts, min(len(texts), 3)):
            begin = draw.randrange(max(1, len(old) - 300))
            piece = old[begin : begin + draw.randrange(40, 300)]
            text += [w if draw.random() > 0.015 else draw.choice(vocabulary) for w in piece]
        texts.append(text + draw.choices(vocabulary, k=20))
    first, wanted = {}, set()
    for i, text in enumerate(texts):
        for at in range(len(text) - 39):
            other = first.setdefault(tuple(text[at : at + 40]), i)
            if other != i:
                wanted.add((i, other, at))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {}
    for r in substring_dedup.repeated_passages(df).collect():
        got.setdefault((r.doc_id, r.other_doc_id), []).append((r["first"], r["last"]))
    lost = [(i, other, at) for i, other, at in wanted if not any(x <= at and at + 39 <= y for x, y in got.get((i, other), []))]
    assert len(wanted) > 5000 and not lost


def test_lm_scores(spark, docs, rows):
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1
    counts = collections.Counter()
    for r in rows:
        if (r.doc_id or 0) % 5 != 1:
            counts.update([*lower_words(r.text), b"\n"])
    total = sum(counts.values())
    divisor = total + 0.5 * (len(counts) + 1)
    want = sorted(round(sum(math.log10((counts[w] + 0.5) / divisor) for w in [*lower_words(r.text), b"\n"]), 4) for r in rows)
    one = score(docs, train, depth=2, max_head=50).collect()
    assert sorted(round(r.base_score, 4) for r in one) == pytest.approx(want)
    assert {r.train_tokens for r in one} == {total} and all(r.score < 0 for r in one)
    # slices change nothing
    two = score(docs, train, depth=2, max_nodes=3_000).collect()
    assert sorted(r.score for r in two) == pytest.approx(sorted(r.score for r in one))


def test_lm_slices_are_bounded(spark, monkeypatch):
    # half of all nodes follow the same two bytes
    draw = [int(hashlib.md5(str(i).encode()).hexdigest(), 16) for i in range(1200)]
    words = [chr(97 + d % 25) + chr(97 + d // 25 % 25) + "zz" + chr(97 + d // 625 % 25) for d in draw]
    df = spark.createDataFrame([(i, " ".join(words[i : i + 100])) for i in range(0, 1200, 100)], "doc_id long, text string")
    want = {r.doc.doc_id: r.score for r in score(df, F.lit(True), depth=4).collect()}
    sizes, written = [], lm_scoring._written

    def measured(*args):
        found = written(*args)
        sizes.extend(n for _, n in found)
        return found

    monkeypatch.setattr(lm_scoring, "_written", measured)
    got = {r.doc.doc_id: r.score for r in score(df, F.lit(True), depth=4, max_nodes=5_000).collect()}
    # beside what is dealt to it, each slice has the nodes of short and of split contexts
    assert len(sizes) > 1 and max(sizes) <= 5_000 + 1_000 and got == pytest.approx(want)


def brute_tree(training, texts, depth):
    """log10 probability of each text under a context tree built with dictionaries, node by node."""
    def body(text):
        return b" ".join(lower_words(text)) + b"\n"

    def decisions(data):
        padded = b"\n" * depth + data
        for i, byte in enumerate(data, depth):
            for k in range(8):
                yield padded[i - depth : i], byte >> (8 - k) | 1 << k, byte >> (7 - k) & 1

    counts = collections.defaultdict(lambda: [0, 0])
    for text in training:
        for context, prefix, bit in decisions(body(text)):
            for d in range(depth + 1):
                counts[context[depth - d :], prefix][bit] += 1
    children = collections.defaultdict(list)
    for context, prefix in counts:
        if context:
            children[context[1:], prefix].append((context, prefix))
    own = {n: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for n, (a, b) in counts.items()}
    block = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        block[node] = own[node]
        if len(node[0]) < depth:
            block[node] = np.logaddexp(own[node], sum(block[c] for c in children[node])) - math.log(2)
    scores = []
    for text in texts:
        total = 0.0
        for context, prefix, bit in decisions(body(text)):
            mixed, left, one = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                node = context[depth - d :], prefix
                if node not in counts:
                    break
                a, b = counts[node]
                p = (b + 0.5) / (a + b + 1)
                # the deepest seen node takes all the weight that is left
                one = mixed + left * p
                stop = math.exp(own[node] - block[node]) / 2 if d < depth else 1.0
                mixed, left = mixed + left * stop * p, left * (1 - stop)
            total += math.log10(one if bit else 1 - one)
        scores.append(total)
    return scores


@pytest.mark.parametrize("depth", [2, 3])
def test_lm_scores_equal_a_tree_built_node_by_node(spark, docs, depth):
    texts = [r.text[:600] for r in docs.where("doc_id < 900000 and text is not null").limit(12).collect()]
    texts += ["", None, "unseen \u00ff\u00fe bytes", "the the the the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc.doc_id: r.score for r in score(df, F.col("doc_id") % 2 == 0, depth=depth).collect()}
    want = brute_tree(texts[::2], texts, depth)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_lm_empty_table(docs):
    assert score(docs.where("false"), F.lit(True)).count() == 0


def test_window_hashes_and_seeds_are_those_of_a_plain_loop():
    plan, draw = substring_dedup.Plan(), np.random.default_rng(5)
    for n in (0, 1, 5, 6, 17, 18, 40, 300):
        for most in (2, 1 << 62):
            hashes = draw.integers(0, most, n).astype(np.uint64)
            for width in (1, 6, 40):
                want = []
                for i in range(n - width + 1):
                    total = 0
                    for h in hashes[i : i + width].tolist():
                        total = (total + h) * 0x9E3779B97F4A7C15 % (1 << 64)
                    want.append(total)
                assert window_hashes(hashes, width).tolist() == mixed(np.array(want, np.uint64)).tolist()
            every = window_hashes(hashes, plan.seed).tolist()
            wide = min(plan.window, len(every))
            first = [min(range(i, i + wide), key=lambda k: (every[k], k)) for i in range(len(every) - wide + 1)] if every else []
            got, at = plan.seeds(hashes)
            assert at.tolist() == sorted(set(first)) and got.tolist() == [every[k] for k in at.tolist()]


def test_an_alignment_on_one_diagonal_takes_both_ends():
    plan, draw = substring_dedup.Plan(), np.random.default_rng(6)
    core = draw.integers(0, 9999, 60).astype(np.uint32)
    a = np.concatenate((draw.integers(20000, 30000, 50), core, draw.integers(20000, 30000, 80))).astype(np.uint32)
    b = np.concatenate((draw.integers(40000, 50000, 10), core, draw.integers(40000, 50000, 90))).astype(np.uint32)
    inside = np.array([[60, 20], [80, 40]])
    assert substring_dedup.align(a, b, inside, plan) == [(50, 109, 10, 69, 60, [50, 109])]
    assert substring_dedup.align(a, b, inside, plan, with_runs=False) == [(50, 109, 10, 69, 60, [])]
    a[75] = 1
    # one changed word: no run of 40 equal words is left
    assert substring_dedup.align(a, b, inside, plan) == [(50, 109, 10, 69, 59, [])]
