"""Shared building blocks: top-k per group and order-based lookups that split hot groups."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# a source may have several buckets; ``label`` names a bucket and its backup, as the registry pairs them
BUCKET = ["source_alias", "label"]
KEY = [*BUCKET, "key"]


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark cuts each task's rows to ``n`` per group before the shuffle (WindowGroupLimit), so no
    task ever receives a whole hot group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def latest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every group, aggregated in each task before the shuffle."""
    newest = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*group).agg(newest.alias("_row")).select("_row.*")


def per_source(df: DataFrame) -> DataFrame:
    """Mark a table with one row per configured source for broadcasting.

    Only for results grouped by ``source_alias`` (or the registry itself): their size is bound by
    the configuration, whatever the inventories hold.
    """
    return F.broadcast(df)


def rows_of_sample(
    df: DataFrame, sample: DataFrame, keys: Sequence[str], bounded: bool
) -> DataFrame:
    """Rows whose key is in ``sample``.

    ``bounded`` says the sample has a fixed number of rows per configured source: it is then
    broadcast and ``df`` is filtered where it is read. Otherwise both sides are shuffled.
    """
    wanted = sample.select(*keys)
    return df.join(F.broadcast(wanted) if bounded else wanted, list(keys), "left_semi")


def count_at_most(entries: Column, value: Column, key: Callable[[Column], Column] = lambda e: e) -> Column:
    """How many entries of an ascending array are at most ``value``: binary search within the row."""
    def step(found: Column, exponent: Column) -> Column:
        further = found + F.call_function("shiftleft", F.lit(1), exponent)
        at_most = key(F.get(entries, further - 1)) <= value
        return F.when((further <= F.size(entries)) & at_most, further).otherwise(found)

    highest = F.floor(F.log2(F.size(entries).cast("double"))).cast("int")
    exponents = F.sequence(highest, F.lit(0), F.lit(-1))
    return F.when(F.size(entries) > 0, F.aggregate(exponents, F.lit(0), step)).otherwise(0)


def broadcast_if_small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``most_rows``, which is counted first."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def range_of(df: DataFrame, keys: Sequence[str], ranges: int, sampled_per_range: int = 16) -> Column:
    """Number of the range of ``keys`` a row falls in; ranges hold about equally many rows.

    Split points come from a sample of ``ranges * sampled_per_range`` rows, each task handing on as many at
    most. Rows are compared with them as a whole, so one key, or one key at one time, may lie in many ranges.
    """
    sample = df.select(*keys).orderBy(F.rand(7)).limit(ranges * sampled_per_range)
    at = F.struct(*keys)
    # sorted by Spark, whose order of strings and NULLs isn't Python's
    points = sample.agg(F.array_sort(F.collect_list(at)).alias("points")).first()["points"]
    splits = [points[len(points) * i // ranges] for i in range(1, ranges)] if points else []
    if not splits:
        return F.lit(0)
    kinds = [field.dataType for field in sample.schema]
    literal = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(p, kinds, keys)]) for p in splits])
    return count_at_most(literal, at)


def neighbours(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
) -> DataFrame:
    """Add columns of the previous (``before``) and the following (``after``) row of the same group, by new name.

    Rows are dealt to ranges of (group, order) by sampled split points, so a group of any size spreads over
    tasks, even one that holds a third of all rows at one time. Neighbours stand in one range except at its
    ends: each range hands its first and last row to the others. Rows and ends read the same shuffle, and there
    are two end rows per range, and four ranges to a shuffle partition. ``order`` must tell the rows of a group apart.
    """
    before, after = before or {}, after or {}
    # several to a partition: ranges are dealt to partitions by hash
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_range", range_of(df, [*group, *order], ranges)).repartition("_range")
    whole, at, here = F.struct(*df.columns), F.struct(*group, *order), F.struct(*group)
    # the ends carry all columns, or the shuffle would be planned twice with different columns
    ends = rows.groupBy("_range").agg(F.min_by(whole, at).alias("_first"), F.max_by(whole, at).alias("_last"))
    numbered = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("_last").over(numbered).alias("_end_before"), F.lead("_first").over(numbered).alias("_end_after"))
    inside = Window.partitionBy("_range", *group).orderBy(*order)

    def beside(shifted: Callable[[str], Column], end: str, column: str) -> Column:
        wrapped = shifted("_values").over(inside)
        same = F.struct(*[F.col(f"{end}.{g}") for g in group]).eqNullSafe(here)
        return F.when(wrapped.isNotNull(), wrapped[column]).when(same, F.col(f"{end}.{column}"))

    values = F.struct(*{*before.values(), *after.values()})
    found = rows.withColumn("_values", values).join(F.broadcast(ends), "_range", "left")
    added = {name: beside(F.lag, "_end_before", column) for name, column in before.items()}
    added |= {name: beside(F.lead, "_end_after", column) for name, column in after.items()}
    return found.withColumns(added).drop("_range", "_values", "_end_before", "_end_after")
