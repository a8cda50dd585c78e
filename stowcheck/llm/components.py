"""Connected components by contraction.

Every node points to the smallest label among its neighbours and itself, edges are redrawn between the labels,
and this repeats until no edge is left. Labels are scrambled ids, so a long chain in id order shrinks by a
constant share per step. Each step is aggregations and joins on stored tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.llm.tables import stored


def scrambled(node: Column) -> Column:
    """A one-to-one map of longs, to break the order of ids: the lower half, multiplied by an odd number
    modulo 2^32, becomes the upper half."""
    low, mask = F.lit(0x9E3779B1 >> 1 | 1), F.lit(0xFFFFFFFF).cast("long")
    upper = F.call_function("shiftleft", (node.bitwiseAND(mask) * low).bitwiseAND(mask), F.lit(32))
    return upper.bitwiseOR(F.call_function("shiftrightunsigned", node, F.lit(32)))


def fresh_labels(nodes: DataFrame) -> DataFrame:
    """(node, label) with every node on its own."""
    return nodes.select("node", scrambled(F.col("node")).alias("label"))


def _through(edges: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Both ends of ``edges`` replaced by what ``mapping`` has for them."""
    a = mapping.select(F.col(key).alias("a"), F.col(value).alias("_a"))
    b = mapping.select(F.col(key).alias("b"), F.col(value).alias("_b"))
    moved = edges.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return moved.where("a <> b").distinct()


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``links`` (a, b: nodes) have joined their components; stored."""
    edges = stored(_through(links, labels, "node", "label"), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("_from")).agg(F.min("b").alias("_to"))
        parents = stored(parents.select("_from", F.least("_from", "_to").alias("_to")), "parents")
        moved = labels.join(parents, labels["label"] == parents["_from"], "left")
        labels = stored(moved.select("node", F.coalesce("_to", "label").alias("label")), "labels")
        edges = stored(_through(edges, parents, "_from", "_to"), "edges")
    return labels
