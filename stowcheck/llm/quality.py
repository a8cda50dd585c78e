"""Quality rules as a short-circuit cascade, all in SQL expressions.

Rules are cheap predicates over a text's measures. What each costs and how many documents it rejects is
estimated on a sample; the cascade then tries rules by rejection per cost and stops at the first that fires.
The order changes the work, never the verdict: a document is kept when no rule rejects it.

Defined results: NULL and empty texts have no words and fail the base rule; repeated rows are judged alike;
other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.words import rows_where, word_array

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text column and a lookup of measures."""

    name: str
    rejects: Callable[[Column, Callable[[str], Column]], Column]


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def few_words(text: Column, m: Callable[[str], Column]) -> Column:
    return m("n_words") < 10


def repeats(text: Column, m: Callable[[str], Column]) -> Column:
    return 100 * m("n_repeat_words") > 20 * m("n_words")


def symbols(text: Column, m: Callable[[str], Column]) -> Column:
    """More than one symbol per ten words."""
    return 10 * m("n_symbols") > m("n_words")


def equal_lines(text: Column, m: Callable[[str], Column]) -> Column:
    """Over 40 % of the lines with a word, and at least five, repeat an earlier one."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != ""))
    return (m("n_dup_lines") >= 5) & (10 * m("n_dup_lines") > 4 * lines)


def shouting(text: Column, m: Callable[[str], Column]) -> Column:
    """More than half of all word characters are capitals."""
    return 2 * _count(text, UPPER) > m("word_chars")


def exclaiming(text: Column, m: Callable[[str], Column]) -> Column:
    """More than one exclamation or question mark per two words."""
    return 2 * _count(text, MARKS) > m("n_words")


def odd_word_length(text: Column, m: Callable[[str], Column]) -> Column:
    """Words of fewer than 2 or more than 20 characters on average."""
    return (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))


def no_letters(text: Column, m: Callable[[str], Column]) -> Column:
    """Fewer than half of the word characters are letters of any script."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return 2 * letters < m("word_chars")


BASE = (Rule("few_words", few_words), Rule("repeats", repeats))
RULES = (
    Rule("symbols", symbols),
    Rule("equal_lines", equal_lines),
    Rule("shouting", shouting),
    Rule("exclaiming", exclaiming),
    Rule("odd_word_length", odd_word_length),
    Rule("no_letters", no_letters),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row as ``doc`` (struct), its text as ``text`` ('' for NULL) and the measures beside it.

    ``n_repeat_words`` sorts one long per window: the upper bits of its hash and its position. Neighbours
    with equal upper bits are compared word by word, so a hash collision doesn't count as a repetition.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct("*").alias("doc"), body.alias("text"))
    df = df.withColumn("_words", word_array(F.col("text")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    words, n = F.col("_words"), F.col("n_words")
    bits = F.coalesce(F.ceil(F.log2(n + 2)).cast("int"), F.lit(62))
    df = df.withColumn("_bits", bits)
    shift = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    lower_cleared = lambda x: F.call_function("shiftleft", shift(x), F.col("_bits"))

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])

    df = df.withColumn("_hashes", F.when(n > WINDOW, F.transform(F.slice(words, 1, F.size(words) - (WINDOW - 1)), window)))
    hashes = F.col("_hashes")
    packed = F.transform(hashes, lambda h, i: lower_cleared(h).bitwiseOR(i.cast("long")))
    # most texts repeat no window: they end here
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn("_keys", F.when(some, F.sort_array(packed)))
    keys = F.col("_keys")

    def position(k: Column) -> Column:
        # the lower bits: what the upper ones leave
        return (k - lower_cleared(k)).cast("int")

    def same(a: Column, b: Column) -> Column:
        at, other = position(a), position(b)
        equal = F.slice(words, at + 1, WINDOW) == F.slice(words, other + 1, WINDOW)
        return F.coalesce((shift(a.bitwiseXOR(b)) == 0) & equal, F.lit(False))

    def repeated(k: Column, j: Column) -> Column:
        return F.when(j > 0, same(k, F.get(keys, j - 1))).otherwise(F.lit(False)) | same(k, F.get(keys, j + 1))

    at = F.sort_array(F.transform(F.filter(keys, repeated), position))
    df = df.withColumn("_at", at)
    at = F.col("_at")
    covered = F.transform(
        at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1), p + WINDOW) - p)
    )
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: F.translate(line, SPACES, "") != "")
    df = df.withColumn("_lines", lines)
    return df.select(
        "doc",
        "text",
        n.alias("n_words"),
        F.length(F.translate(F.col("text"), SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias(
            "n_repeat_words"
        ),
    )


def ordered_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> list[Rule]:
    """Rules by estimated rejection per cost, best first; ties keep their order.

    The sample of ``sample_rows`` rows decides only the order. A rule's cost is the time its predicate adds
    to a pass over the stored measures.
    """
    sample = measured.select("text", *MEASURES).limit(sample_rows).toArrow()
    df = measured.sparkSession.createDataFrame(sample)

    def timed(*columns: Column) -> tuple[float, list]:
        start = time.perf_counter()
        found = df.agg(F.count("*"), *columns).first()
        return time.perf_counter() - start, list(found)

    rejected = [F.count_if(rule.rejects(F.col("text"), F.col)) for rule in rules]
    counts = timed(*rejected)[1][1:]
    empty_pass = timed()[0]
    score = {}
    for rule, count, column in zip(rules, counts, rejected, strict=True):
        cost = max(timed(column)[0] - empty_pass, 1e-3)
        score[rule.name] = count / cost
    return sorted(rules, key=lambda rule: -score[rule.name])


def judge(measured: DataFrame, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``; a rule runs only where all before it passed."""
    text, base, verdict = F.col("text"), F.lit(False), F.lit(True)
    for rule in reversed(BASE):
        base = F.when(rule.rejects(text, F.col), F.lit(True)).otherwise(base)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text, F.col), F.lit(False)).otherwise(verdict)
    df = measured.withColumn("base_failed", base)
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict))


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> DataFrame:
    """``doc`` (the whole row), its measures, ``base_failed`` and ``kept``."""
    measured = measure(docs, text)
    return judge(measured, ordered_rules(measured, rules, sample_rows))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    return rows_where(quality(docs, text), F.col("kept")).select("doc.*")
