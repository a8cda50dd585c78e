"""Inventory snapshots: selection, latest partitions, counts and day-over-day change."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowcheck.constants import FRESHNESS_HOURS
from stowcheck.functions.keys import delivery_fields, is_operational
from stowcheck.functions.objects import is_archived, is_current
from stowcheck.functions.times import age_hours
from stowcheck.operators.toolkit import BUCKET, first_per_group, per_source


def snapshot(inventory: DataFrame, alias: str, side: str, dt: str) -> DataFrame:
    """One stored snapshot; all three predicates are partition filters."""
    return inventory.where(
        (F.col("dt") == dt) & (F.col("source_alias") == alias) & (F.col("side") == side)
    )


def current(inventory: DataFrame) -> DataFrame:
    return inventory.where(is_current(F.col("is_latest"), F.col("is_delete_marker")))


def without_operational(df: DataFrame) -> DataFrame:
    return df.where(~is_operational(F.col("key")))


def source_side(inventory: DataFrame, dt: str) -> DataFrame:
    return current(inventory.where((F.col("side") == "source") & (F.col("dt") == dt)))


def backup_side(inventory: DataFrame, dt: str) -> DataFrame:
    """Reserved prefixes exist on the backup side only and are dropped there."""
    return without_operational(
        current(inventory.where((F.col("side") == "backup") & (F.col("dt") == dt)))
    )


# a snapshot is that of a bucket: buckets of one source, and the two sides of one bucket, are delivered apart
SNAPSHOT = [*BUCKET, "side"]


def delivery_catalogue(listing: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_alias, label, side, bucket, dt, delivered_at) of every delivered snapshot, from a listing alone:
    the paths (key), and where it has them the times (last_modified).

    ``pairs`` names the label of a bucket and of its backup (source_alias, label, source_bucket, backup_bucket).
    Paths that name no snapshot, and buckets that aren't registered, are left out.
    """
    both = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_bucket").alias("bucket")),
        F.struct(F.lit("backup").alias("side"), F.col("backup_bucket").alias("bucket")),
    )
    labels = pairs.select(*BUCKET, F.inline(both)).distinct()
    at = F.col("last_modified") if "last_modified" in listing.columns else F.lit(None).cast("timestamp")
    delivered = listing.select(delivery_fields(F.col("key")).alias("_of"), at.alias("_at")).where(F.col("_of").isNotNull())
    named = delivered.select("_of.*", "_at").join(per_source(labels), ["source_alias", "side", "bucket"])
    return named.groupBy(*SNAPSHOT, "bucket", "dt").agg(F.max("_at").alias("delivered_at"))


def latest_partitions(catalogue: DataFrame) -> DataFrame:
    """Newest ``dt`` per bucket and side; a bucket without delivery has no row."""
    return catalogue.groupBy(*SNAPSHOT).agg(F.max("dt").alias("dt"))


def two_latest_partitions(catalogue: DataFrame) -> DataFrame:
    delivered = catalogue.select(*SNAPSHOT, "dt").distinct()
    window = Window.partitionBy(*SNAPSHOT).orderBy(F.desc("dt"))
    return (
        delivered.withColumn("newest", F.row_number().over(window).cast("bigint"))
        .where(F.col("newest") <= 2)
    )


def newest_delivered(catalogue: DataFrame, today: str) -> DataFrame:
    """Newest ``dt`` at or before ``today`` per bucket and side.

    Each is delivered independently: the newest backup may be older than the newest source, and one bucket of a
    source older than another.
    """
    return latest_partitions(catalogue.where((F.col("dt") > "") & (F.col("dt") <= today)))


def at_delivered(inventory: DataFrame, newest: DataFrame) -> DataFrame:
    """Rows of the snapshots in ``newest`` (one per configured bucket and side).

    ``newest`` is broadcast; its keys prune the partitions of a stored inventory at run time. Spark only does so
    behind a comparison, hence the one on ``dt``.
    """
    wanted = newest.select(*SNAPSHOT, "dt").where(F.col("dt") > "")
    return inventory.join(per_source(wanted), [*SNAPSHOT, "dt"], "left_semi")


def newest_source(inventory: DataFrame, newest: DataFrame) -> DataFrame:
    return current(at_delivered(inventory, newest.where(F.col("side") == "source")))


def newest_backup(inventory: DataFrame, newest: DataFrame) -> DataFrame:
    return without_operational(current(at_delivered(inventory, newest.where(F.col("side") == "backup"))))


def at_latest(inventory: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of every bucket and side; no row of another snapshot is read."""
    return at_delivered(inventory, latest_partitions(catalogue))


def newest_nonempty(listing: DataFrame, modified: str, *by: str) -> DataFrame:
    """Newest object per group, ignoring 0-byte placeholders."""
    return listing.where(F.col("size") > 0).groupBy(*by).agg(
        F.max(modified).alias("latest"), F.count("*").alias("objects")
    )


def storage_class_counts(inventory: DataFrame) -> DataFrame:
    archived = is_archived(F.col("storage_class"))
    return inventory.groupBy("source_alias", "side", "dt").agg(
        F.count_if(~archived).alias("restorable"), F.count_if(archived).alias("archived")
    )


def snapshot_count(inventory: DataFrame) -> DataFrame:
    return (
        current(inventory)
        .groupBy("source_alias", "side", "dt")
        .agg(F.count("*").alias("objects"))
    )


def _change(counts: DataFrame, by: list[str]) -> DataFrame:
    """Previous count and change per group. One row per snapshot, so the window is small."""
    window = Window.partitionBy(*by).orderBy("dt")
    return counts.withColumns(
        {
            "previous_dt": F.lag("dt").over(window),
            "previous_objects": F.lag("objects").over(window),
        }
    ).withColumns({"delta": F.col("objects") - F.col("previous_objects"), "delta_pct": _percent("objects", "previous_objects")})


def _percent(now: str, before: str) -> Column:
    return F.when(F.col(before) != 0, (F.col(now) - F.col(before)) / F.col(before) * 100)


def bucket_counts(inventory: DataFrame) -> DataFrame:
    """Current objects of every snapshot (source_alias, label, side, dt); one without any counts 0."""
    alive = is_current(F.col("is_latest"), F.col("is_delete_marker"))
    return inventory.groupBy(*SNAPSHOT, "dt").agg(F.count_if(alive).alias("objects"))


def count_delta(counts: DataFrame, side: str = "source") -> DataFrame:
    """Newest snapshot of every bucket against the one before it, from ``bucket_counts``.

    A snapshot without current rows still counts as delivered, with 0 objects.
    """
    changes = _change(counts.where(F.col("side") == side), SNAPSHOT)
    newest = first_per_group(changes, SNAPSHOT, [F.desc("dt")], 1)
    return newest.select(
        *BUCKET,
        F.col("dt").alias("today_dt"),
        F.col("objects").alias("today_count"),
        F.col("previous_dt").alias("yesterday_dt"),
        F.col("previous_objects").alias("yesterday_count"),
        "delta",
        "delta_pct",
        F.col("previous_dt").isNotNull().alias("available"),
    )


def source_delta(deltas: DataFrame) -> DataFrame:
    """``count_delta`` summed per source over its buckets that have two snapshots; NULL if none has."""
    compared = F.when(F.col("available"), F.col("today_count"))
    sums = deltas.groupBy("source_alias").agg(F.sum(compared).alias("_now"), F.sum("yesterday_count").alias("_before"))
    return sums.select("source_alias", (F.col("_now") - F.col("_before")).alias("delta"), _percent("_now", "_before").alias("delta_pct"))


def daily_growth(inventory: DataFrame) -> DataFrame:
    """Source count of every snapshot with its change to the one before."""
    counts = snapshot_count(inventory.where(F.col("side") == "source"))
    return _change(counts, ["source_alias", "side"]).drop("side")


def inventory_freshness(
    deliveries: DataFrame, now: Column, threshold_hours: float = FRESHNESS_HOURS
) -> DataFrame:
    """Newest delivery per side; the effective time needs both sides and is the older one."""
    real = F.col("size") > 0
    sides = deliveries.groupBy("source_alias").agg(
        F.max(F.when(real & (F.col("side") == "source"), F.col("last_modified"))).alias(
            "source_latest"
        ),
        F.max(F.when(real & (F.col("side") == "backup"), F.col("last_modified"))).alias(
            "backup_latest"
        ),
    )
    both = F.col("source_latest").isNotNull() & F.col("backup_latest").isNotNull()
    # least() skips NULLs, so both sides are checked first
    effective = F.when(both, F.least("source_latest", "backup_latest"))
    age = age_hours(now, F.col("effective_data_ts"))
    return (
        sides.withColumn("effective_data_ts", effective)
        .withColumn("age_hours", age)
        .withColumn("stale", F.coalesce(F.col("age_hours") > threshold_hours, F.lit(False)))
    )
