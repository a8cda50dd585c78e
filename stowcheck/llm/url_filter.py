"""URL filter: rules by host and path prefix, and logistic regression on hashed character n-grams.

A rule's verdict stands where one fits; all other URLs are judged by a model trained from a small table of
labelled URLs. Everything is SQL expressions; training runs one aggregation per step, and only the weight
vector, whose length is a parameter, comes to the driver.

Defined results: a NULL URL and one without ``://`` have an empty host and path and are judged by the model's
intercept; repeated rows are judged alike; long URLs are used whole; without labelled rows of both kinds the
model allows everything; other columns pass through.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
MAX_RULES = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


RULES = (
    Rule(ALLOW, "org/"),
    Rule(BLOCK, "example.org/es/"),
    Rule(BLOCK, "example.org/en/1"),
    Rule(ALLOW, "com/fr/"),
    Rule(BLOCK, "com/de/"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's."""
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, NULL without one.

    Rules are configuration, compiled into the plan; their number is bounded by ``MAX_RULES``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    longest = sorted(rules, key=lambda r: (-len(r.rule), r.rule))
    found = [F.when(fits(r, host, path), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


def features(host: Column, path: Column, dimension: int, sizes: Sequence[int] = (3, 4)) -> Column:
    """Distinct hashed character n-grams; those of the host and of the path are told apart."""

    def of_size(chars: Column, mark: str, n: int) -> Column:
        def gram(i: Column) -> Column:
            return F.pmod(F.xxhash64(F.lit(f"{mark}{n}"), *[F.get(chars, i + k) for k in range(n)]), F.lit(dimension)).cast("int")

        # a text shorter than n is one shorter gram
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), gram)

    def grams(text: Column, mark: str) -> Column:
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        return F.concat(*[of_size(chars, mark, n) for n in sizes])

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def margin(grams: Column, weights: Sequence[float], intercept: float) -> Column:
    """Intercept plus the weights of the grams, scaled by the square root of their number."""
    # one text literal that Spark folds into an array; a literal of every weight is slow to plan
    table = F.from_json(F.lit(json.dumps([float(w) for w in weights])), "array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g))
    return F.lit(float(intercept)) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)))


def probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    intercept: float

    def score(self, host: Column, path: Column) -> Column:
        """Probability of being blocked."""
        return probability(margin(features(host, path, len(self.weights)), self.weights, self.intercept))


def train(
    labelled: DataFrame,
    dimension: int = 4096,
    steps: int = 15,
    rate: float = 0.5,
    l2: float = 1e-3,
    max_rows: int = 20_000,
    store=None,
) -> UrlModel:
    """Logistic regression on (host, path, label), label 1 to block.

    ``max_rows`` bounds the labelled rows used: those with the smallest hash of host and path, so reruns use
    the same. The gradient of each step is summed on the executors and one number per weight is collected;
    weights follow it with per-weight step sizes.
    """
    known = labelled.where(F.col("label").isin(0, 1)).select("host", "path", "label")
    used = known.orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_rows)
    rows = used.select(F.col("label").cast("double").alias("label"), features(F.col("host"), F.col("path"), dimension).alias("g"))
    rows = store(rows) if store else rows
    n, blocked = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not blocked or blocked == n:
        return UrlModel((0.0,) * dimension, -1.0)
    weights, slopes = [0.0] * dimension, [1e-8] * dimension
    intercept = math.log(blocked / (n - blocked))
    for _ in range(steps):
        error = probability(margin(F.col("g"), weights, intercept)) - F.col("label")
        scaled = rows.select((error / F.sqrt(F.greatest(F.size("g"), F.lit(1)))).alias("e"), error.alias("raw"), "g")
        pushed = scaled.select("e", F.explode(F.concat("g", F.array(F.lit(-1)))).alias("g"), "raw")
        sums = pushed.groupBy("g").agg(F.sum(F.when(F.col("g") >= 0, F.col("e")).otherwise(F.col("raw"))).alias("s"))
        for g, s in sums.collect():
            if g < 0:
                intercept -= rate * s / n
                continue
            slope = s / n + l2 * weights[g]
            slopes[g] += slope * slope
            weights[g] -= rate * slope / math.sqrt(slopes[g])
    return UrlModel(tuple(weights), intercept)


def judge(urls: DataFrame, model: UrlModel, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """``row`` (the whole row), host, path, rule, score (probability of block) and verdict."""
    df = urls.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = df.withColumn("_rule", match_rules(F.col("host"), F.col("path"), rules))
    df = df.withColumn("score", model.score(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return df.select("row", "host", "path", F.col("_rule.rule").alias("rule"), "score", verdict.alias("verdict"))


def labelled_by_rules(urls: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """A labelled URL table: the distinct (host, path) that a rule decides."""
    df = urls.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = df.withColumn("verdict", match_rules(F.col("host"), F.col("path"), rules)["verdict"])
    return df.where("verdict IS NOT NULL").select("host", "path", (F.col("verdict") == BLOCK).cast("int").alias("label")).distinct()
