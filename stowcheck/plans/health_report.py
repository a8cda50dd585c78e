"""The daily health report: every signal of every source in one plan."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.constants import FRESHNESS_HOURS, MISSING_SAMPLE_SIZE, RESTORE_SAMPLE_SIZE
from stowcheck.operators import health, operations, reconcile, restore, snapshots
from stowcheck.operators.toolkit import per_source
from stowcheck.session import work_path


@dataclass
class ReportInputs:
    # the same rows twice: ``inventory`` for matching keys, ``listed`` for reads that match none
    inventory: DataFrame
    listed: DataFrame
    live: DataFrame
    deliveries: DataFrame
    registry: DataFrame
    pairs: DataFrame
    owners: DataFrame
    counts: DataFrame
    run_states: DataFrame
    jobs: DataFrame
    exports: DataFrame
    tables: DataFrame
    checksums: DataFrame
    restored: DataFrame
    now: Column
    today: str
    weekday: int
    canary: str
    rotation: dict[int, str] = field(default_factory=dict)


def process_signals(inputs: ReportInputs) -> tuple[DataFrame, DataFrame]:
    """(signals per source, latest job per bucket with its source)."""
    states = operations.current_run_state(inputs.run_states)
    newest_exports = operations.latest_export(inputs.exports, inputs.tables)
    failures = operations.owned(operations.job_failure_rate(inputs.jobs), inputs.owners)
    signals = health.process_signals(
        inputs.registry,
        operations.last_backup_age(states, newest_exports, inputs.now),
        operations.export_summary(newest_exports),
        failures,
    )
    return signals, failures


def newest_snapshots(inputs: ReportInputs) -> DataFrame:
    """Newest snapshot per bucket and side, from the delivery listing."""
    return snapshots.newest_delivered(snapshots.delivery_catalogue(inputs.deliveries, inputs.pairs), inputs.today)


def restore_results(inputs: ReportInputs, sample_size: int = RESTORE_SAMPLE_SIZE) -> DataFrame:
    """Restore-test result of every bucket of the sources due today."""
    due = restore.restore_test_targets(
        inputs.registry, inputs.weekday, inputs.canary, inputs.rotation
    )
    backup = snapshots.newest_backup(inputs.listed, newest_snapshots(inputs))
    backup = backup.join(due, "source_alias", "left_semi")
    sample = restore.sample_restore_hash(backup, sample_size)
    verified = restore.restore_verify(sample, inputs.restored, inputs.checksums, bounded=True)
    return restore.bucket_results(verified, inputs.pairs.join(due, "source_alias", "left_semi"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def health_rows(inputs: ReportInputs, freshness_hours: float = FRESHNESS_HOURS) -> DataFrame:
    """One row per source with all signals, notes and the overall status.

    Each bucket's newest snapshot is compared with its backup's newest, however old either is. The keys of
    both are aggregated once, and those on one side only are written down: the counts and the missing sample
    read them. Everything joined afterwards has one row per source.
    """
    newest = newest_snapshots(inputs)
    sides = _stored(reconcile.differing(reconcile.newest_key_sides(inputs.inventory, newest)), "differing-keys")
    divergence = reconcile.source_divergence(reconcile.divergence_counts(sides, newest), inputs.pairs)
    missing = sides.where((F.col("in_backup") == 0) & (F.col("in_source") > 0))
    checked = restore.head_check(
        reconcile.missing_sample(missing.select("source_alias", "label", "key"), MISSING_SAMPLE_SIZE),
        inputs.live,
        bounded=True,
    )
    freshness = snapshots.inventory_freshness(inputs.deliveries, inputs.now, freshness_hours)
    delta = snapshots.source_delta(snapshots.count_delta(inputs.counts))
    process, failures = process_signals(inputs)
    tested = restore.restore_test_overall(restore_results(inputs), "source_alias")

    enabled = F.col("inventory_enabled")

    def gated(name: str, alias: str) -> Column:
        return F.when(enabled, F.col(name)).alias(alias)

    key = "source_alias"
    signals = (
        inputs.registry.select(key, "inventory_enabled")
        .distinct()
        .join(per_source(freshness), key, "left")
        .join(per_source(delta), key, "left")
        .join(per_source(divergence), key, "left")
        .join(per_source(checked), key, "left")
        .join(per_source(tested.select(key, F.col("overall").alias("restore_result"))), key, "left")
        .join(per_source(health.pitr_by_source(inputs.tables)), key, "left")
        .join(per_source(process), key, "left")
        .join(per_source(health.batch_notes(failures)), key, "left")
        .select(
            key,
            "inventory_enabled",
            gated("age_hours", "inventory_age_hours"),
            F.coalesce(gated("stale", "_"), F.lit(False)).alias("inventory_stale"),
            gated("delta", "delta"),
            gated("delta_pct", "delta_pct"),
            gated("source_minus_backup", "missing"),
            gated("backup_minus_source", "orphans"),
            gated("buckets_unavailable", "buckets_unavailable"),
            gated("still_missing", "still_missing"),
            gated("auto_healed", "auto_healed"),
            gated("tag", "tag"),
            "restore_result",
            "pitr_enabled",
            "pitr_tables",
            "last_backup_at",
            F.col("last_backup_age_hours").alias("backup_age_hours"),
            F.col("worst_failure_pct").alias("failure_pct"),
            "alarming_buckets",
            "exports_completed",
            "exports_in_progress",
            "exports_failed",
            "exports_no_recent",
            "exports_errored",
            "batch_warnings",
            "batch_infos",
        )
    )
    warnings, infos = health.notes()
    return signals.select(
        "*",
        health.classify_source(freshness_hours).alias("overall"),
        warnings.alias("notes"),
        infos.alias("info_notes"),
    ).drop("batch_warnings", "batch_infos")
