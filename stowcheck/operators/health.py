"""Health signals, classification, notes and report roll-ups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowcheck.constants import (
    BACKUP_AGE_RED_HOURS,
    BACKUP_AGE_YELLOW_HOURS,
    BATCH_FAILURE_RED,
    FRESHNESS_HOURS,
)
from stowcheck.operators.toolkit import per_source


def process_signals(
    sources: DataFrame, last_backup: DataFrame, exports: DataFrame, failures: DataFrame
) -> DataFrame:
    """One row per source: last backup age, worst failure share, export counts.

    ``failures`` has the latest job per bucket with its ``source_alias``.
    """
    worst = failures.groupBy("source_alias").agg(
        F.max("failure_pct").alias("worst_failure_pct"),
        F.count_if("alarming").alias("alarming_buckets"),
    )
    lanes = ["completed", "in_progress", "failed", "no_recent", "errored"]
    return (
        sources.select("source_alias")
        .distinct()
        .join(per_source(last_backup), "source_alias", "left")
        .join(per_source(worst), "source_alias", "left")
        .join(
            per_source(exports.select("source_alias", *[F.col(c).alias(f"exports_{c}") for c in lanes])),
            "source_alias", "left",
        )
        .na.fill(0, ["alarming_buckets", *[f"exports_{c}" for c in lanes]])
    )


def _enabled() -> Column:
    return F.coalesce(F.col("pitr_status") == "ENABLED", F.lit(False))


def pitr_status(tables: DataFrame) -> DataFrame:
    """Per table; an unreadable (NULL) status counts as disabled."""
    return tables.select("source_alias", "table_name", _enabled().alias("enabled"), "latest_restorable")


def pitr_by_source(tables: DataFrame) -> DataFrame:
    """All tables protected? With the per-table map (as long as the configuration)."""
    entries = F.array_sort(F.collect_list(F.struct("table_name", _enabled().alias("enabled"))))
    return tables.groupBy("source_alias").agg(
        F.bool_and(_enabled()).alias("pitr_enabled"),
        F.map_from_entries(entries).alias("pitr_tables"),
    )


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _failing(missing: Column) -> Column:
    enabled = F.col("inventory_enabled")
    return (
        _true(F.col("restore_result") == "failed")
        | _true(~F.col("pitr_enabled"))
        | (enabled & F.col("inventory_age_hours").isNull())
        | (enabled & _true(missing))
    )


def classify_source(
    freshness_hours: float = FRESHNESS_HOURS,
    red_hours: float = BACKUP_AGE_RED_HOURS,
    yellow_hours: float = BACKUP_AGE_YELLOW_HOURS,
    failure_red: float = BATCH_FAILURE_RED,
) -> Column:
    """red on failures of the backup's job, yellow on forward-looking risk, else green."""
    age = F.col("backup_age_hours")
    red = (
        _failing(F.col("missing") > 0)
        | _true(age > red_hours)
        | _true(F.col("failure_pct") > failure_red)
        | _true(F.col("exports_failed") > 0)
    )
    stale = F.col("inventory_enabled") & _true(F.col("inventory_age_hours") > freshness_hours)
    return F.when(red, "red").when(stale | _true(age > yellow_hours), "yellow").otherwise("green")


def classify_four_color(freshness_hours: float = FRESHNESS_HOURS) -> Column:
    """Proposed taxonomy: healed gaps, staleness, orphans and count changes are amber; idle is blue."""
    enabled, age = F.col("inventory_enabled"), F.col("inventory_age_hours")
    missing, still = F.col("missing") > 0, F.col("still_missing") > 0
    amber = enabled & (
        _true(missing & ~still)
        | _true(age > freshness_hours)
        | _true(F.col("orphans") > 0)
        | _true(F.col("delta") != 0)
    )
    quiet = _true(F.col("delta") == 0) & _true(F.col("orphans") == F.col("orphans_before")) & _true(
        age <= freshness_hours
    )
    tested = F.coalesce(F.col("restore_result") == "passed", F.lit(True))
    return (
        F.when(_failing(missing & still), "red")
        .when(amber, "amber")
        .when((~enabled | quiet) & tested, "blue")
        .otherwise("green")
    )


def _rank(order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col("overall"))


def report_overall(report: DataFrame, order: tuple[str, ...] = ("green", "yellow", "red")) -> DataFrame:
    """Worst status of all sources; an empty report is green."""
    worst = F.coalesce(F.max(_rank(order)), F.lit(1))
    return report.agg(
        F.element_at(F.array(*map(F.lit, order)), worst.cast("int")).alias("overall"),
        F.count_if(F.col("overall") == "green").alias("healthy"),
        F.count("*").alias("total"),
    )


def report_headline(overall: DataFrame, report_date: Column) -> DataFrame:
    return overall.select(
        F.format_string(
            "backup health %s — %s (%d/%d)",
            F.date_format(report_date, "yyyy-MM-dd"), F.upper("overall"), F.col("healthy"), F.col("total"),
        ).alias("headline")
    )


# --- notes ------------------------------------------------------------------------------------


def _hours(column: Column) -> Column:
    # half-even like the reports before it, then printed
    return F.format_string("%.1f", F.bround(column, 1))


def batch_notes(failures: DataFrame, failure_red: float = BATCH_FAILURE_RED) -> DataFrame:
    """Lines about the latest job per bucket, gathered per source (one per configured bucket)."""
    share, failed, total = F.col("failure_pct"), F.col("tasks_failed"), F.col("total_tasks")
    # fixed wording of the notes
    warning = F.when(
        (total > 0) & (share > failure_red),
        F.format_string(
            f"S3 batch %s: %,d/%,d failed (%.0f%%, > {failure_red * 100:.0f}%% red threshold)",
            F.col("bucket"), failed, total, F.bround(share * 100, 0),
        ),
    )
    info = F.when(
        warning.isNull() & (failed > 0),
        F.format_string(
            "S3 batch %s: %,d/%,d failed (%.1f%%)", F.col("bucket"), failed, total, F.bround(share * 100, 1)
        ),
    )
    lines = F.array_sort(F.collect_list(F.struct("bucket", "warning", "info")))
    return (
        failures.select("source_alias", "bucket", warning.alias("warning"), info.alias("info"))
        .groupBy("source_alias")
        .agg(lines.alias("_lines"))
        .select(
            "source_alias",
            F.col("_lines.warning").alias("batch_warnings"),
            F.col("_lines.info").alias("batch_infos"),
        )
    )


def notes(red_hours: float = BACKUP_AGE_RED_HOURS, yellow_hours: float = BACKUP_AGE_YELLOW_HOURS) -> tuple[Column, Column]:
    """(warning lines, info lines) of a source row with its signals joined on."""
    enabled, age = F.col("inventory_enabled"), F.col("backup_age_hours")
    delta, pct = F.col("delta"), F.col("delta_pct")
    pct_text = F.coalesce(F.format_string(" (%+.1f%%)", F.bround(pct, 1)), F.lit(""))
    pct_text = F.when(pct.isNull(), "").otherwise(pct_text)
    verb = F.when(delta > 0, "grew").otherwise("dropped")
    table_lane = {lane: F.col(f"exports_{lane}") for lane in ("completed", "in_progress", "failed", "no_recent", "errored")}
    # fixed wording of the notes
    warnings = F.concat(
        F.array(
            F.when(enabled & F.col("inventory_age_hours").isNull(), "no inventory data available"),
            F.when(
                enabled & (F.col("missing") > 0),
                F.format_string("backup is missing %,d source keys%s", F.col("missing"), F.coalesce("tag", F.lit(""))),
            ),
            F.when(age.isNull(), "no recent backup run on record (never run? config drift?)")
            .when(
                age > red_hours,
                F.format_string(f"last backup %sh ago (> {red_hours:.0f}h red threshold)", _hours(age)),
            )
            .when(
                age > yellow_hours,
                F.format_string(f"last backup %sh ago (> {yellow_hours:.0f}h yellow threshold)", _hours(age)),
            ),
        ),
        F.coalesce("batch_warnings", F.array().cast("array<string>")),
        F.array(
            F.when(
                table_lane["failed"] > 0,
                F.format_string("DynamoDB exports: %d table(s) FAILED on last run", table_lane["failed"]),
            ),
            F.when(
                table_lane["errored"] > 0,
                F.format_string("DynamoDB exports: status check errored on %d table(s)", table_lane["errored"]),
            ),
        ),
    )
    infos = F.concat(
        F.array(
            F.when(
                enabled & (delta != 0),
                F.format_string("source %s by %,d objects vs yesterday%s", verb, F.abs(delta), pct_text),
            ),
            F.when(
                enabled & (F.col("orphans") > 0),
                F.format_string("backup has %,d orphans (source-side deletions retained)", F.col("orphans")),
            ),
            F.when(age <= yellow_hours, F.format_string("last backup %sh ago", _hours(age))),
        ),
        F.coalesce("batch_infos", F.array().cast("array<string>")),
        F.array(
            F.when(
                (table_lane["no_recent"] > 0)
                & ((table_lane["completed"] > 0) | (table_lane["in_progress"] > 0)),
                F.format_string("DynamoDB exports: %d table(s) with no recent export", table_lane["no_recent"]),
            )
        ),
    )
    return F.array_compact(warnings), F.array_compact(infos)


# --- pre-flight -------------------------------------------------------------------------------


def source_check(
    registry: DataFrame,
    freshness: DataFrame,
    tables: DataFrame,
    freshness_hours: float = FRESHNESS_HOURS,
) -> DataFrame:
    """Rows PASS/WARN/FAIL per source: snapshot per side, effective data time, PITR per table.

    A table whose status cannot be read fails; one without PITR is a warning.
    """
    def shown(ts: str) -> Column:
        return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")

    def snapshot(bucket: str, ts: str) -> Column:
        return F.struct(
            F.concat(F.lit("Inventory snapshot "), bucket).alias("check"),
            F.when(F.col(ts).isNotNull(), "PASS").otherwise("WARN").alias("outcome"),
            F.coalesce(shown(ts), F.lit("no artifacts yet")).alias("detail"),
        )

    effective = F.struct(
        F.lit("Inventory effective data time").alias("check"),
        F.when(F.col("effective_data_ts").isNotNull(), "PASS").otherwise("WARN").alias("outcome"),
        F.coalesce(shown("effective_data_ts"), F.lit("not yet available")).alias("detail"),
    )
    fresh = F.struct(
        F.lit("Inventory freshness").alias("check"),
        F.when(F.col("age_hours") <= freshness_hours, "PASS").otherwise("WARN").alias("outcome"),
        F.coalesce(F.format_string("%sh", _hours(F.col("age_hours"))), F.lit("not yet available")).alias("detail"),
    )
    inventory_rows = (
        registry.join(per_source(freshness), "source_alias", "left")
        .select(
            "source_alias",
            F.explode(
                F.array(
                    snapshot("source_bucket", "source_latest"),
                    snapshot("backup_bucket", "backup_latest"),
                    effective,
                    fresh,
                )
            ).alias("row"),
        )
        .select("source_alias", "row.*")
    )
    status = F.col("pitr_status")
    pitr_rows = tables.select(
        "source_alias",
        F.concat(F.lit("PITR "), "table_name").alias("check"),
        F.when(status.isNull(), "FAIL").when(status == "ENABLED", "PASS").otherwise("WARN").alias("outcome"),
        F.when(status.isNull(), "status not readable")
        .when(status == "ENABLED", "")
        .otherwise(F.concat(F.lit("status="), status, F.lit(" — enable PITR before backup")))
        .alias("detail"),
    )
    return inventory_rows.unionByName(pitr_rows)


def orphans_with_before(orphans_by_dt: DataFrame) -> DataFrame:
    """Orphan count per snapshot with the one before it (one row per snapshot)."""
    window = Window.partitionBy("source_alias").orderBy("dt")
    return orphans_by_dt.withColumn("orphans_before", F.lag("orphans").over(window))
