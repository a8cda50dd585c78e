"""Restore planning, sampling and verification."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.constants import RESTORE_SAMPLE_SIZE
from stowcheck.functions.keys import encode_key, is_operational
from stowcheck.functions.objects import is_archived, normalize_etag, pick_checksum
from stowcheck.operators.snapshots import without_operational
from stowcheck.operators.toolkit import BUCKET, KEY, first_per_group, per_source, rows_of_sample


def with_prefix(df: DataFrame, prefix: str | None) -> DataFrame:
    """Literal prefix; stored Parquet sees it as StringStartsWith."""
    return df.where(F.col("key").startswith(prefix)) if prefix else df


def restore_manifest(backup: DataFrame, prefix: str | None = None) -> DataFrame:
    """Everything but reserved prefixes, encoded: recovery starts from a clean, known state."""
    return without_operational(with_prefix(backup, prefix)).select(
        "source_alias", "bucket", encode_key(F.col("key")).alias("key")
    )


def restore_diff(backup: DataFrame, target: DataFrame, prefix: str | None = None) -> DataFrame:
    """Objects to restore: those the target does not hold with the same tag."""
    wanted = without_operational(with_prefix(backup, prefix)).select(*KEY, "size", "e_tag")
    present = with_prefix(target, prefix).select(*KEY, "e_tag")
    return wanted.join(present, [*KEY, "e_tag"], "left_anti")


def restore_diff_summary(backup: DataFrame, target: DataFrame, prefix: str | None = None) -> DataFrame:
    wanted = without_operational(with_prefix(backup, prefix))
    total = wanted.groupBy("source_alias").agg(F.count("*").alias("_objects"))
    copied = restore_diff(backup, target, prefix).groupBy("source_alias").agg(
        F.count("*").alias("objects_copied"), F.sum("size").alias("bytes_transferred")
    )
    return (
        total.join(per_source(copied), "source_alias", "left")
        .na.fill(0)
        .select(
            "source_alias",
            "objects_copied",
            (F.col("_objects") - F.col("objects_copied")).alias("objects_skipped"),
            "bytes_transferred",
        )
    )


def select_restore_targets(inventory: DataFrame, registry: DataFrame, chosen: list[str]) -> DataFrame:
    """Inventory rows of the chosen buckets, named by label, source name or backup name.

    The registry is as small as the configuration; Spark broadcasts it by its measured size.
    """
    names = ("label", "source_bucket", "backup_bucket")
    picked = registry.where(reduce(or_, (F.col(n).isin(*chosen) for n in names)))
    buckets = picked.select("source_alias", F.explode(F.array("source_bucket", "backup_bucket")).alias("bucket"))
    return inventory.join(buckets, ["source_alias", "bucket"], "left_semi")


def restorable(backup: DataFrame) -> DataFrame:
    return backup.where(~is_operational(F.col("key")) & ~is_archived(F.col("storage_class")))


def sample_restore_random(backup: DataFrame, n: int = RESTORE_SAMPLE_SIZE, seed: int | None = None) -> DataFrame:
    """Random ``n`` restorable objects of every bucket; fewer give all."""
    drawn = restorable(backup).select(*KEY, "e_tag", "size", F.rand(seed).alias("_draw"))
    return first_per_group(drawn, BUCKET, [F.col("_draw"), F.col("key")], n).drop("_draw")


def _draw(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col("key")))


def sample_restore_hash(backup: DataFrame, n: int = RESTORE_SAMPLE_SIZE, seed: str = "0") -> DataFrame:
    """Repeatable sample of ``n`` per bucket, ordered by a seeded hash of the key."""
    return first_per_group(
        restorable(backup).select(*KEY, "e_tag", "size"),
        BUCKET,
        [_draw(seed), F.col("key")],
        n,
    )


def _picked(checksums: DataFrame, side: str, name: str) -> DataFrame:
    return checksums.where(F.col("side") == side).select(
        *KEY, pick_checksum(checksums.columns).alias(name)
    )


def restore_verify(
    sample: DataFrame,
    restored: DataFrame,
    checksums: DataFrame,
    expected_side: str = "backup",
    restored_side: str = "source",
    bounded: bool = False,
) -> DataFrame:
    """Compare restored copies with their originals: same-algorithm checksum, else the tag.

    ``bounded``: the sample has a fixed number of rows per source (see ``rows_of_sample``).
    """
    restored = rows_of_sample(restored, sample, KEY, bounded)
    checksums = rows_of_sample(checksums, sample, KEY, bounded)
    copies = restored.select(*KEY, F.col("e_tag").alias("_tag"), F.lit(True).alias("_found"))
    ours, theirs = F.col("_ours"), F.col("_theirs")
    comparable = F.coalesce(ours.algorithm == theirs.algorithm, F.lit(False))
    copied = F.col("_found").isNotNull()
    tag, copy_tag = normalize_etag(F.col("e_tag")), normalize_etag(F.col("_tag"))
    # fixed wording of the outcome
    detail = F.when(
        ~copied, F.lit("object not found in restore target")
    ).when(
        comparable & (ours.value != theirs.value),
        F.format_string("%s mismatch: %s != %s", ours.algorithm, ours.value, theirs.value),
    ).when(
        ~comparable & ~tag.eqNullSafe(copy_tag),
        F.format_string("ETag mismatch: %s != %s", copy_tag, tag),
    )
    return (
        sample.join(copies, KEY, "left")
        .join(_picked(checksums, expected_side, "_ours"), KEY, "left")
        .join(_picked(checksums, restored_side, "_theirs"), KEY, "left")
        .select(
            *KEY,
            F.when(~copied, "copy_error")
            .when(detail.isNotNull(), "mismatch")
            .otherwise("verified")
            .alias("outcome"),
            detail.alias("detail"),
        )
    )


def bucket_results(verified: DataFrame, pairs: DataFrame) -> DataFrame:
    """Restore-test result per registered bucket and its backup; one without a sample is skipped.

    The keys in error are listed: samples, and so the lists, have a fixed number of rows per bucket.
    """
    def keys_of(outcome: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.struct("key", "detail"))))

    tested = verified.groupBy(*BUCKET).agg(
        F.count("*").alias("sample_count"), keys_of("copy_error").alias("errors"), keys_of("mismatch").alias("mismatches")
    )
    failed = F.greatest(F.size("errors"), F.size("mismatches")) > 0
    return (
        pairs.select(*BUCKET, "source_bucket", "backup_bucket")
        .join(per_source(tested), BUCKET, "left")
        .na.fill(0, ["sample_count"])
        .withColumn(
            "result",
            F.when(F.col("sample_count") == 0, "skipped").when(failed, "failed").otherwise("passed"),
        )
    )


def restore_test_overall(results: DataFrame, *by: str) -> DataFrame:
    """failed if any failed; skipped if all skipped (or none ran); else passed."""
    overall = (
        F.when(F.bool_or(F.col("result") == "failed"), "failed")
        .when(F.coalesce(F.bool_and(F.col("result") == "skipped"), F.lit(True)), "skipped")
        .otherwise("passed")
    )
    return results.groupBy(*by).agg(
        overall.alias("overall"), F.count("*").alias("buckets")
    )


def head_check(sample: DataFrame, live: DataFrame, bounded: bool = False) -> DataFrame:
    """How many sampled missing keys exist live by now, with the note's tag."""
    found = rows_of_sample(live.select(*KEY), sample, KEY, bounded).distinct()
    checked = sample.select(*KEY).join(found.withColumn("_live", F.lit(True)), KEY, "left")
    counts = checked.groupBy("source_alias").agg(
        F.count("*").alias("sample_size"),
        F.count_if(F.col("_live").isNull()).alias("still_missing"),
        F.count_if(F.col("_live").isNotNull()).alias("auto_healed"),
    )
    return counts.withColumn("tag", head_check_tag())


def head_check_tag() -> Column:
    size, missing, healed = map(F.col, ("sample_size", "still_missing", "auto_healed"))
    # fixed wording of the note
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, F.lit(""))
        .when(missing == size, F.format_string(" (still missing live, sampled %d)", size))
        .when(healed == size, F.format_string(" (auto-healed since snapshot, sampled %d)", size))
        .otherwise(
            F.format_string(
                " (%d still missing, %d auto-healed, sampled %d)", missing, healed, size
            )
        )
    )


def restore_test_targets(
    registry: DataFrame, weekday: int, canary: str, rotation: dict[int, str]
) -> DataFrame:
    """Registered sources tested on a weekday (0 = Monday): the canary and the day's rotation."""
    today = {canary, rotation.get(weekday)} - {None}
    return registry.where(F.col("source_alias").isin(*today)).select("source_alias").distinct()
