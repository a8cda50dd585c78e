"""Version history: mutations, rollback, point in time, run correlation and purge batches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowcheck.constants import PURGE_BATCH_SIZE, VERSION_RETENTION_DAYS
from stowcheck.operators.toolkit import (
    BUCKET,
    KEY,
    broadcast_if_small,
    count_at_most,
    latest_per_group,
    neighbours,
)

ORDER = ["last_modified", "version_id"]


def version_changes(versions: DataFrame) -> DataFrame:
    """Each version against the one before it: a true mutation, or a re-copy of equal content."""
    used = versions.select("key", *ORDER, "e_tag")
    paired = neighbours(used, ["key"], ORDER, before={"previous_e_tag": "e_tag"})
    kind = (
        F.when(F.col("previous_e_tag").isNull(), "first")
        .when(F.col("previous_e_tag") == F.col("e_tag"), "recopy")
        .otherwise("mutation")
    )
    return paired.select("key", "version_id", "last_modified", "e_tag", "previous_e_tag", kind.alias("kind"))


def with_superseded_at(versions: DataFrame, *columns: str) -> DataFrame:
    """Key, order and ``columns`` of every version (all by default) with the time of the one after it."""
    used = versions.select("key", *ORDER, *columns) if columns else versions
    return neighbours(used, ["key"], ORDER, after={"superseded_at": "last_modified"})


def mutated_in_window(versions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Versions written or superseded inside [start, end]."""
    return (
        neighbours(versions.select("key", *ORDER), ["key"], ORDER, after={"superseded_at": "last_modified"})
        .select(
            "key",
            "version_id",
            "last_modified",
            "superseded_at",
            F.col("last_modified").between(start, end).alias("written"),
            F.coalesce(F.col("superseded_at").between(start, end), F.lit(False)).alias("superseded"),
        )
        .where(F.col("written") | F.col("superseded"))
    )


def last_good_version(versions: DataFrame, start: Column, end: Column) -> DataFrame:
    """For keys written inside [start, end]: the newest version before, to roll back to."""
    before = F.when(F.col("last_modified") < start, F.struct(*ORDER))
    good = F.max_by(
        F.struct("version_id", "last_modified", "e_tag", "size", "is_delete_marker"), before
    )
    return (
        versions.groupBy("key")
        .agg(
            F.bool_or(F.col("last_modified").between(start, end)).alias("_mutated"),
            good.alias("_good"),
        )
        .where(F.col("_mutated") & F.col("_good").isNotNull())
        .select("key", "_good.*")
    )


def restore_as_of(versions: DataFrame, at: Column) -> DataFrame:
    """State at a point in time: newest version per key; a delete marker removes the key."""
    return latest_per_group(
        versions.where(F.col("last_modified") <= at), ["key"], ORDER
    ).where(~F.col("is_delete_marker"))


def noncurrent_expiry(
    versions: DataFrame, at: Column, retention_days: int = VERSION_RETENTION_DAYS
) -> DataFrame:
    """Superseded versions kept longer than the retention; 0 days keeps them forever."""
    expires = F.col("superseded_at") + F.make_dt_interval(days=F.lit(retention_days))
    kept_forever = retention_days == 0
    return (
        with_superseded_at(versions, "size")
        .where(~F.lit(kept_forever) & (expires <= at))
        .select("key", "version_id", "size", "superseded_at", expires.alias("expired_at"))
    )


def runs_by_day(runs: DataFrame) -> DataFrame:
    """(source_alias, day, runs, carried): the runs of each day in order, and the last run before it.

    There is a row for every day from a source's first run to the day after its last; of several runs started
    at once the one with the largest id counts. Windows are over the days of a source.
    """
    daily = runs.groupBy("source_alias", F.to_date("started_at").alias("_from")).agg(
        F.array_sort(F.collect_list(F.struct("started_at", "run_id"))).alias("runs")
    )
    days = Window.partitionBy("source_alias").orderBy("_from")
    last = F.element_at("runs", -1)
    spans = daily.select(
        "source_alias",
        "_from",
        "runs",
        F.lag(last).over(days).alias("_before"),
        F.coalesce(F.lead("_from").over(days), F.date_add("_from", 2)).alias("_until"),
    )
    each = spans.withColumn("day", F.explode(F.sequence(F.col("_from"), F.date_sub("_until", 1))))
    first = F.col("day") == F.col("_from")
    return each.select(
        "source_alias",
        "day",
        F.when(first, F.col("runs")).otherwise(F.slice("runs", 1, 0)).alias("runs"),
        F.when(first, F.col("_before")).otherwise(last).alias("carried"),
    )


def mutation_run_match(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """The backup run that wrote each version: the last run of its source started by then.

    Versions are neither sorted nor copied. Each is joined with the runs of its source and day, in order, and
    its run is searched for within the row. The runs are broadcast if their days are few, which is counted;
    else both sides are shuffled by source and day, and AQE splits a day that holds many versions.
    """
    by_day = runs_by_day(runs)
    ends = by_day.groupBy("source_alias").agg(F.max("day").alias("_end"))
    known = versions.select("source_alias", "key", "version_id", "last_modified").join(broadcast_if_small(ends), "source_alias", "left")
    # later versions belong to the day after the last run, which has that run carried in
    day = F.least(F.to_date("last_modified"), F.col("_end"))
    matched = known.withColumn("day", day).join(broadcast_if_small(by_day), ["source_alias", "day"], "left")
    started = count_at_most(F.col("runs"), F.col("last_modified"), lambda run: run["started_at"])
    writer = F.when(started > 0, F.get("runs", started - 1)).otherwise(F.col("carried"))
    return matched.withColumn("_writer", writer).select(
        "source_alias",
        "key",
        "version_id",
        "last_modified",
        F.col("_writer.run_id").alias("run_id"),
        F.col("_writer.started_at").alias("run_started_at"),
    )


def purge_batches(orphans: DataFrame, batch_size: int = PURGE_BATCH_SIZE) -> DataFrame:
    """Cut each bucket's orphans into batches of exactly ``batch_size`` keys (the last is shorter).

    Keys are spread over 4096 hash groups, numbered inside their group, and shifted by the rows of
    the groups before it: no task sees a whole bucket, and a retried task repeats its numbers. The
    offsets are 4096 rows per bucket at most. Numbers and offsets read the same shuffle, so the
    orphans are found once.
    """
    groups = [*BUCKET, "hash_group"]
    # never NULL, so that the join below adds no filter to one of the two branches only
    group = F.coalesce(F.left(F.md5("key"), F.lit(3)), F.lit(""))
    spread = orphans.select(*KEY, group.alias("hash_group")).repartition(*groups)
    before = Window.partitionBy(*BUCKET).orderBy("hash_group").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        spread.groupBy(*groups).agg(F.count("key").alias("_rows"))
        .select(*groups, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*groups).orderBy("key")
    position = F.col("_offset") + F.col("_number") - 1
    return (
        spread.withColumn("_number", F.row_number().over(inside))
        .join(offsets, groups)
        .select(
            *KEY,
            F.floor(position / batch_size).cast("bigint").alias("batch"),
            (position % batch_size).alias("position"),
        )
    )
