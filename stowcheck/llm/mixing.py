"""Mixing sources to target weights by Pareto order sampling, all in SQL expressions.

A source's target over its size is the number of copies each of its documents is due. The whole part is
allocated to every document; the rest is drawn: documents are ranked by their random odds divided by their
inclusion odds, and the ranking's first documents are taken until their words come nearest to what is left.

Defined results: NULL texts have size 0; a NULL source is a source of its own, last in order; repeated rows
share their random number and are drawn together; documents of size 0
take nothing; a source without words has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowcheck.llm.words import text_digest, unit_hash, word_array

WEIGHTS = (3.0, 1.0, 2.0)
BUCKET_BITS = 16
MAX_COPIES = 2.0


def size_of(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5) -> DataFrame:
    """source, source_size, target from rows (source, size), by water filling.

    With the sources in order of the level at which they reach their cap (2 x size / weight), those before
    the level are capped and the rest share what remains by weight. One row per source is left here, so
    windows over all of them are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(MAX_COPIES) * F.col("source_size"))
    per = per.withColumn("level", F.col("cap") / F.col("weight"))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(all_rows)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # the water level if this source and all after it are below their caps
    per = per.withColumn("_water", left / F.sum("weight").over(from_here))
    settled = F.min(F.when(F.col("_water") <= F.col("level"), F.struct("level", "_water"))).over(all_rows)
    per = per.withColumn("_settled", settled)
    below = F.col("_settled").isNotNull() & (F.col("level") >= F.col("_settled.level"))
    target = F.when(below, F.col("_settled._water") * F.col("weight")).otherwise(F.col("cap"))
    return per.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    preference: Column | None = None,
    seed: int = 20240131,
) -> DataFrame:
    """``doc`` (the whole row), size, source_size, target and ``copies`` of every document.

    ``preference`` multiplies a document's inclusion odds; by default long documents are a little less likely
    to get the drawn copy, as odds fall with the logarithm of the size. The running sum of words over a
    ranking is taken in two steps, so that a source with a third of all rows is never sorted in one task:
    ranks are cut into 2^16 bins, whole bins are summed first, and only the bin in which the target lies is
    summed document by document.
    """
    base = docs.select(
        F.struct("*").alias("doc"),
        F.col(source).alias("source"),
        size_of(F.col(text)).alias("size"),
        unit_hash(seed, F.col(doc_id), text_digest(F.col(text))).alias("_u"),
    )
    targets = source_targets(base.select("source", "size"), weights, share)
    targets = targets.withColumn("_due", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    targets = targets.withColumn("_whole", F.floor(F.col("_due") + 1e-12))
    rest = F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))
    targets = targets.withColumn("_rest", rest)
    targets = targets.withColumn("_p", F.greatest(F.col("_due") - F.col("_whole"), F.lit(0.0)))
    # one row per source
    joined = base.join(F.broadcast(targets), base["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    prefer = F.lit(1.0) / F.log(F.col("size") + F.lit(2.718281828459045)) if preference is None else preference
    # random odds / inclusion odds, pressed into (0, 1) without changing the order
    odds, included = F.col("_u") / (1 - F.col("_u")), (F.col("_p") / (1 - F.col("_p"))) * prefer
    rank = F.when(F.col("_p") > 0, odds / (odds + included)).otherwise(F.lit(1.0))
    ranked = joined.withColumn("_rank", rank)
    last_bin = (1 << BUCKET_BITS) - 1
    ranked = ranked.withColumn("_bin", F.least(F.floor(F.col("_rank") * (last_bin + 1)).cast("int"), F.lit(last_bin)))

    bins = ranked.groupBy("source", "_bin", "_rest").agg(F.sum("size").alias("_in_bin"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_in_bin").over(upto), F.lit(0)))
    cut = bins.where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_in_bin") > F.col("_rest")))
    # one row per source
    cut = cut.select(F.col("source").alias("_s"), F.col("_bin").alias("_cut"), "_before")
    at_cut = ranked["source"].eqNullSafe(F.col("_s"))
    inside = ranked.join(F.broadcast(cut), at_cut & (F.col("_bin") == F.col("_cut")))
    order = Window.partitionBy("source").orderBy("_rank", "size")
    inside = inside.select("source", "_rank", "size", "_rest", "_before", F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.row_number().over(order).alias("_nth"))
    # nearest to the rest, with or without the document that crosses it
    off = F.abs(F.col("_before") + F.col("_upto") - F.col("_rest"))
    best = inside.groupBy("source", "_rest", "_before").agg(
        F.min(F.struct(off.alias("off"), "_nth", F.col("_rank").alias("rank"), F.col("size").alias("size"))).alias("_b")
    )
    none_better = (F.col("_rest") - F.col("_before")) <= F.col("_b.off")
    best = best.select(
        F.col("source").alias("_bs"),
        F.when(none_better, F.lit(-1.0)).otherwise(F.col("_b.rank")).alias("_last_rank"),
        F.when(none_better, F.lit(-1)).otherwise(F.col("_b.size")).alias("_last_size"),
    )
    cuts = cut.join(F.broadcast(best), F.col("_s").eqNullSafe(F.col("_bs"))).drop("_bs", "_before")
    out = ranked.join(F.broadcast(cuts), ranked["source"].eqNullSafe(F.col("_s")), "left")
    in_cut = (F.col("_rank") < F.col("_last_rank")) | (
        (F.col("_rank") == F.col("_last_rank")) & (F.col("size") <= F.col("_last_size"))
    )
    # no bin crosses the rest: everything is due (or nothing is left)
    drawn = F.when(F.col("_cut").isNull(), F.col("_p") > 0)
    drawn = drawn.when(F.col("_bin") < F.col("_cut"), True).when(F.col("_bin") == F.col("_cut"), in_cut).otherwise(False)
    copies = F.col("_whole") + F.when((F.col("_p") > 0) & drawn, F.lit(1)).otherwise(F.lit(0))
    return out.select("doc", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed_copies(docs: DataFrame, **options) -> DataFrame:
    """One row per copy the mix takes: the document's columns and ``copy``, counted from 1."""
    taken = mix(docs, **options).where(F.col("copies") > 0)
    name = "copy" if "copy" not in docs.columns else "mix_copy"
    return taken.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(name))
