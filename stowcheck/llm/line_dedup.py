"""Line dedup over overlapping windows of three lines.

Every three consecutive lines that hold a word are hashed; windows that occur more than once anywhere are
found with one aggregation, and all lines covered by a later occurrence are removed. Occurrences are ordered
by document (doc_id, NULL last, then a digest of the text) and place; the first of a window stays.

Defined results: documents without a removed line, NULL and empty texts among them, come out as they are;
blank lines take no part and stay; rows that repeat doc_id and text are cleaned alike and don't make each
other's lines repeated ones; rows of one doc_id with different texts are different documents; a text of fewer
than three lines has no window; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.words import SPACE, rows_where, text_digest

LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """_id, _key, at, h1, h2 of every window; ``at`` numbers the lines with a word."""
    spoken = F.filter(_lines(F.col(text)), lambda line: F.regexp_replace(line, SPACE, "") != "")
    df = docs.select(F.col(doc_id).alias("_id"), text_digest(F.col(text)).alias("_key"), spoken.alias("_lines"))
    df = df.where(F.size("_lines") >= LINES)
    lines = F.col("_lines")

    def window(i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(LINES)]
        return F.struct(i.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *parts).alias("h2"))

    every = F.transform(F.sequence(F.lit(0), F.size(lines) - LINES), window)
    return df.select("_id", "_key", F.inline(every))


def later_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """_id, _key, at of every occurrence after a window's first."""
    windows = _windows(docs, text, doc_id)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"), "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select("h1", "h2", "_first")
    again = windows.join(first, ["h1", "h2"]).where(place > F.col("_first"))
    return again.select("_id", "_key", "at")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc`` (the whole row), the cleaned ``text``, n_lines (with a word) and n_removed of every row."""
    again = later_windows(docs, text, doc_id).groupBy("_id", "_key").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    body = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("_doc_id"), F.col(text).alias("text"))
    same = body["_doc_id"].eqNullSafe(again["_id"]) & (text_digest(F.col("text")) == again["_key"])
    df = body.join(again, same, "left").select("doc", "text", "_at", _lines(F.col("text")).alias("_lines"))
    numbered = F.transform("_lines", lambda line, i: F.when(F.regexp_replace(line, SPACE, "") != "", i).otherwise(-1))
    df = df.withColumn("_spoken", F.filter(numbered, lambda i: i >= 0))
    merged = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.sequence(a, a + LINES - 1))))
    df = df.withColumn("_gone", F.transform(merged, lambda i: F.get(F.col("_spoken"), i)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    return df.select(
        "doc",
        F.when(F.col("_at").isNull(), F.col("text")).otherwise(cleaned).alias("text"),
        F.coalesce(F.size("_spoken"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with cleaned texts; a document that loses all its lines is removed."""
    done = dedup_lines(docs, text, doc_id)
    done = rows_where(done, (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return done.select(*[F.col("text").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])
