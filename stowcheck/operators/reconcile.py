"""Source against backup: manifests, divergence, missing and orphaned keys, integrity.

Joins are on (source_alias, label, key): a bucket is compared with its own backup only, and one key may
stand in several buckets of a source. A snapshot's current rows of a bucket hold a key once, so a hot
source spreads evenly over its keys. ``with_label`` adds the label to rows that know only their bucket.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.constants import MISSING_SAMPLE_SIZE
from stowcheck.functions.keys import encode_key, is_operational
from stowcheck.functions.objects import (
    is_multipart,
    needs_copy_smart,
    needs_copy_strict,
    normalize_etag,
    pick_checksum,
)
from stowcheck.operators.snapshots import at_delivered, current, without_operational
from stowcheck.operators.toolkit import BUCKET, KEY, first_per_group, per_source


def with_label(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (source_alias, bucket, ...) of either side with the label the registry gives their bucket.

    Rows of buckets that aren't registered have no place in a reconciliation and are left out.
    """
    sides = registry.select(*BUCKET, F.explode(F.array("source_bucket", "backup_bucket")).alias("bucket"))
    return rows.join(per_source(sides.distinct()), ["source_alias", "bucket"])


def paired(source: DataFrame, backup: DataFrame) -> DataFrame:
    """Every source object with its backup copy, if any."""
    copies = backup.select(
        *KEY,
        F.col("size").alias("backup_size"),
        F.col("e_tag").alias("backup_e_tag"),
        F.lit(True).alias("_found"),
    )
    return (
        source.select(*KEY, "bucket", "size", "e_tag")
        .join(copies, KEY, "left")
        .withColumn("missing", F.col("_found").isNull())
        .drop("_found")
    )


def _sides() -> tuple[Column, Column, Column, Column, Column]:
    return tuple(map(F.col, ("missing", "size", "backup_size", "e_tag", "backup_e_tag")))


def changed_smart(source: DataFrame, backup: DataFrame, full_sync: bool = False) -> DataFrame:
    if full_sync:
        return source.select(*KEY, "bucket", "size", "e_tag")
    return paired(source, backup).where(needs_copy_smart(*_sides()))


def changed_strict(source: DataFrame, backup: DataFrame, full_sync: bool = False) -> DataFrame:
    return paired(source, backup).where(needs_copy_strict(*_sides(), full_sync=full_sync))


def as_manifest(objects: DataFrame) -> DataFrame:
    return objects.select("source_alias", "bucket", encode_key(F.col("key")).alias("key"))


def inventory_diff(source: DataFrame, backup: DataFrame, full_sync: bool = False) -> DataFrame:
    """Copy manifest from two snapshots. With no backup snapshot every source key is listed."""
    return as_manifest(changed_smart(source, backup, full_sync))


def manifest_count(source: DataFrame, backup: DataFrame, full_sync: bool = False) -> DataFrame:
    """Manifest rows per source; the keys are not encoded for it."""
    return (
        changed_smart(source, backup, full_sync)
        .groupBy("source_alias")
        .agg(F.count("*").alias("objects"))
    )


def key_sides(inventory: DataFrame, source_dt: str, backup_dt: str | None = None) -> DataFrame:
    """``sides_per_key`` of the snapshots of given dates."""
    side = F.col("side")
    chosen = (side == "source") & (F.col("dt") == source_dt) | (side == "backup") & (
        F.col("dt") == (backup_dt or source_dt)
    )
    return sides_per_key(inventory.where(chosen))


def newest_key_sides(inventory: DataFrame, newest: DataFrame) -> DataFrame:
    """``sides_per_key`` of the snapshots in ``newest``, one per bucket and side."""
    return sides_per_key(at_delivered(inventory, newest))


def sides_per_key(snapshots: DataFrame) -> DataFrame:
    """Current rows per key on each side, in one scan of both snapshots.

    Equivalent to a full outer join for everything that only needs keys: rows of a key meet in a
    hash aggregation, partly before the one shuffle, and nothing is sorted. An inventory bucketed by
    (source_alias, label, key) needs no shuffle either.
    """
    side = F.col("side")
    rows = current(snapshots).where(
        (side == "source") | ~is_operational(F.col("key"))
    )
    return rows.groupBy(*KEY).agg(
        F.count_if(side == "source").alias("in_source"),
        F.count_if(side == "backup").alias("in_backup"),
    )


def differing(sides: DataFrame) -> DataFrame:
    """Keys on one side only: all that counts and samples of a divergence need of ``sides_per_key``."""
    return sides.where((F.col("in_source") == 0) | (F.col("in_backup") == 0))


def divergence_counts(sides: DataFrame, delivered: DataFrame) -> DataFrame:
    """Counts in both directions per bucket from ``key_sides``, or what ``differing`` leaves of it; NULL unless both sides have a snapshot.

    ``delivered`` holds the compared (source_alias, label, side, dt): a delivered snapshot without current
    keys is available and counts as empty.
    """
    compared = delivered.groupBy(*BUCKET).agg(
        F.max(F.when(F.col("side") == "source", F.col("dt"))).alias("source_dt"),
        F.max(F.when(F.col("side") == "backup", F.col("dt"))).alias("backup_dt"),
    )
    counts = sides.groupBy(*BUCKET).agg(
        F.sum(F.when(F.col("in_backup") == 0, F.col("in_source")).otherwise(0)).alias("_missing"),
        F.sum(F.when(F.col("in_source") == 0, F.col("in_backup")).otherwise(0)).alias("_orphans"),
    )
    available = F.col("source_dt").isNotNull() & F.col("backup_dt").isNotNull()
    none = F.lit(0).cast("bigint")
    # one row per configured bucket
    return compared.join(per_source(counts), BUCKET, "left").select(
        *BUCKET,
        "source_dt",
        "backup_dt",
        F.when(available, F.coalesce("_missing", none)).alias("source_minus_backup"),
        F.when(available, F.coalesce("_orphans", none)).alias("backup_minus_source"),
        available.alias("available"),
    )


def source_divergence(divergence: DataFrame, pairs: DataFrame) -> DataFrame:
    """``divergence_counts`` summed per source over its available buckets; NULL if there is none.

    ``buckets_unavailable`` counts registered buckets that can't be compared, those never delivered included.
    """
    every = pairs.select(*BUCKET).distinct().join(per_source(divergence), BUCKET, "left")
    return every.groupBy("source_alias").agg(
        F.sum("source_minus_backup").alias("source_minus_backup"),
        F.sum("backup_minus_source").alias("backup_minus_source"),
        F.count_if(~F.coalesce("available", F.lit(False))).alias("buckets_unavailable"),
    )


def missing_keys(source: DataFrame, backup: DataFrame) -> DataFrame:
    return source.select(*KEY).join(backup.select(*KEY), KEY, "left_anti")


def orphan_keys(source: DataFrame, backup: DataFrame) -> DataFrame:
    """Keys only the backup still has. Filters precede the join on both sides."""
    return backup.select(*KEY).join(source.select(*KEY), KEY, "left_anti")


def missing_sample(missing: DataFrame, n: int = MISSING_SAMPLE_SIZE) -> DataFrame:
    """The first ``n`` missing keys of every bucket, by key."""
    return first_per_group(missing, BUCKET, [F.col("key")], n)


def key_except(sides: DataFrame) -> DataFrame:
    """Distinct keys on one side only, tagged."""
    return differing(sides).select(
        *KEY,
        F.when(F.col("in_backup") == 0, "source_only").otherwise("backup_only").alias("found_in"),
    )


def key_intersect(sides: DataFrame) -> DataFrame:
    return sides.where((F.col("in_source") > 0) & (F.col("in_backup") > 0)).select(*KEY)


def listing_diff(source: DataFrame, backup: DataFrame, full_sync: bool = False) -> DataFrame:
    """Strict diff of two live listings, with the reason per key."""
    size_differs = ~F.col("size").eqNullSafe(F.col("backup_size"))
    tag_differs = ~F.col("e_tag").eqNullSafe(F.col("backup_e_tag"))
    reason = (
        F.when(F.col("missing"), "missing")
        .when(tag_differs, "etag")
        .when(size_differs, "size")
        .otherwise("forced")
    )
    return changed_strict(source, backup, full_sync).select(
        "source_alias", "bucket", encode_key(F.col("key")).alias("key"), "size", reason.alias("reason")
    )


def sync_summary(source: DataFrame, backup: DataFrame, full_sync: bool = False) -> DataFrame:
    copy = needs_copy_strict(*_sides(), full_sync=full_sync)
    return (
        paired(source, backup)
        .groupBy("source_alias")
        .agg(
            F.count_if(copy).alias("objects_copied"),
            F.count_if(~copy).alias("objects_skipped"),
            F.sum(F.when(copy, F.col("size")).otherwise(0)).alias("bytes_transferred"),
        )
    )


# --- integrity --------------------------------------------------------------------------------


def _checksums(checksums: DataFrame, side: str) -> DataFrame:
    picked = pick_checksum(checksums.columns)
    return (
        checksums.where((F.col("side") == side) & picked.isNotNull())
        .select(*KEY, picked.alias(f"{side}_checksum"))
    )


def integrity_status(source: DataFrame, backup: DataFrame, checksums: DataFrame) -> DataFrame:
    """One row per source key whose copy is absent or has another tag, with its outcome.

    Equal tags end the comparison; equal checksums of the same algorithm verify the copy; a
    multipart tag on either side cannot be compared and counts as verified. Size is not compared.
    Reserved prefixes are dropped on both sides. Checksums are looked up only for keys whose tags
    differ.
    """
    tag, copy_tag = normalize_etag(F.col("e_tag")), normalize_etag(F.col("backup_e_tag"))
    pairs = paired(without_operational(source), without_operational(backup)).where(
        F.col("missing") | (tag != copy_tag)
    )
    ours, theirs = F.col("source_checksum"), F.col("backup_checksum")
    same = F.coalesce(
        (ours.algorithm == theirs.algorithm) & (ours.value == theirs.value), F.lit(False)
    )
    conflict = F.coalesce(
        (ours.algorithm == theirs.algorithm) & (ours.value != theirs.value), F.lit(False)
    )
    multipart = is_multipart(tag) | is_multipart(copy_tag)
    return (
        pairs.join(_checksums(checksums, "source"), KEY, "left")
        .join(_checksums(checksums, "backup"), KEY, "left")
        .select(
            *KEY,
            F.col("e_tag").alias("source_etag"),
            F.col("backup_e_tag").alias("backup_etag"),
            F.when(F.col("missing"), "missing_in_backup")
            .when(same | multipart, "verified")
            .otherwise("etag_mismatch")
            .alias("issue"),
            (~F.col("missing") & conflict).alias("checksum_conflict"),
        )
    )


def integrity_diffs(status: DataFrame) -> DataFrame:
    return status.where(F.col("issue") != "verified")


def integrity_summary(source: DataFrame, backup: DataFrame, status: DataFrame) -> DataFrame:
    """Object counts per side and outcome counts per source."""
    kept = ~is_operational(F.col("key"))
    both = source.where(kept).select("source_alias", F.lit("source").alias("side")).unionByName(
        backup.where(kept).select("source_alias", F.lit("backup").alias("side"))
    )
    objects = both.groupBy("source_alias").agg(
        F.count_if(F.col("side") == "source").alias("source_object_count"),
        F.count_if(F.col("side") == "backup").alias("backup_object_count"),
    )
    outcomes = status.groupBy("source_alias").agg(
        F.count_if(F.col("issue") == "missing_in_backup").alias("missing_count"),
        F.count_if(F.col("issue") == "etag_mismatch").alias("mismatch_count"),
        F.count_if(F.col("issue") == "verified").alias("checksum_verified"),
    )
    joined = objects.join(per_source(outcomes), "source_alias", "left").na.fill(0)
    return joined.withColumn(
        "clean", (F.col("missing_count") == 0) & (F.col("mismatch_count") == 0)
    )
