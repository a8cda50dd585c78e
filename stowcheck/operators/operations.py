"""Run states, jobs, exports, events and metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck import schemas
from stowcheck.constants import (
    BATCH_FAILURE_RED,
    EVENT_LIMIT,
    METRIC_WINDOW_MINUTES,
    RECENT_EXPORTS,
    RECENT_JOBS,
    SUCCESS_STATUSES,
)
from stowcheck.functions.text import (
    description_target,
    details_field,
    event_extent,
    event_target,
    job_kind,
)
from stowcheck.functions.times import age_hours
from stowcheck.operators.toolkit import first_per_group, latest_per_group, per_source


def current_run_state(run_states: DataFrame) -> DataFrame:
    """Last written state per bucket from the append-only table."""
    return latest_per_group(run_states, ["bucket"], ["checked_at", "event_id"])


def scan_batch_jobs(jobs: DataFrame, description_contains: str) -> DataFrame:
    return jobs.where(F.contains("description", F.lit(description_contains)))


def job_progress(jobs: DataFrame) -> DataFrame:
    """A finished job without failures counts as fully succeeded: its report lists failures only."""
    total, failed = F.col("total_tasks"), F.col("tasks_failed")
    finished = (F.col("status") == "Complete") & (failed == 0) & (total > 0)
    return (
        jobs.withColumn("succeeded", F.when(finished, total).otherwise(F.col("tasks_succeeded")))
        .withColumn("done", F.col("succeeded") + failed)
        .withColumn(
            "percent_complete",
            F.when(total > 0, F.bround(F.try_divide("done", "total_tasks") * 100, 1)).otherwise(0.0),
        )
        .select("job_id", "status", "total_tasks", "succeeded", "tasks_failed", "done", "percent_complete")
    )


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS, kind: str | None = None) -> DataFrame:
    """Newest ``n`` jobs per bucket. The kind is filtered before the cut."""
    wanted = jobs.where(job_kind(F.col("description")) == kind) if kind else jobs
    return first_per_group(wanted, ["bucket"], [F.desc("creation_time"), F.col("job_id")], n)


def job_targets(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id",
        job_kind(F.col("description")).alias("kind"),
        description_target(F.col("description")).alias("target"),
    )


def job_failure_rate(jobs: DataFrame, red: float = BATCH_FAILURE_RED) -> DataFrame:
    """Failed share of the most recent job per bucket."""
    latest = first_per_group(jobs, ["bucket"], [F.desc("creation_time"), F.col("job_id")], 1)
    pct = F.coalesce(F.try_divide("tasks_failed", "total_tasks"), F.lit(0.0))
    return latest.select(
        "bucket",
        "job_id",
        "status",
        "total_tasks",
        "tasks_failed",
        pct.alias("failure_pct"),
        (pct > red).alias("alarming"),
    )


def failed_tasks(report: DataFrame) -> DataFrame:
    """Reasons in a job's failure report, most frequent first when sorted by ``tasks``."""
    return report.where(F.col("task_status") != "succeeded").groupBy("bucket", "error_code").agg(
        F.count("*").alias("tasks")
    )


def recent_exports(exports: DataFrame, n: int = RECENT_EXPORTS) -> DataFrame:
    return first_per_group(
        exports,
        ["source_alias", "table_name"],
        [F.desc("export_time"), F.col("export_arn")],
        n,
    )


def latest_export(exports: DataFrame, tables: DataFrame) -> DataFrame:
    """Newest export per configured table, with the table's lane in the summary."""
    newest = recent_exports(exports, 1).select(
        "source_alias", "table_name", "export_arn", "status", "export_time"
    )
    lane = (
        F.when(F.upper("status") == "COMPLETED", "completed")
        .when(F.upper("status") == "IN_PROGRESS", "in_progress")
        .when(F.upper("status") == "FAILED", "failed")
        # history that could not be read is stored as a row without status
        .when(F.col("export_arn").isNotNull() & F.col("status").isNull(), "errored")
        .otherwise("no_recent")
    )
    return (
        tables.select("source_alias", "table_name")
        .join(newest, ["source_alias", "table_name"], "left")
        .withColumn("lane", lane)
    )


def export_summary(latest: DataFrame) -> DataFrame:
    lanes = ("completed", "in_progress", "failed", "no_recent", "errored")
    return latest.groupBy("source_alias").agg(
        *[F.count_if(F.col("lane") == lane).alias(lane) for lane in lanes]
    )


def latest_completed_export(exports: DataFrame, tables: DataFrame) -> DataFrame:
    """Count and newest of the completed exports per table; none is a failure."""
    done = exports.where(F.col("status") == "COMPLETED").groupBy("source_alias", "table_name").agg(
        F.count("*").alias("completed"),
        F.max_by("export_arn", F.struct("export_time", "export_arn")).alias("export_arn"),
        F.max("export_time").alias("export_time"),
    )
    return (
        tables.select("source_alias", "table_name")
        .join(done, ["source_alias", "table_name"], "left")
        .na.fill(0, ["completed"])
        .withColumn("failed", F.col("completed") == 0)
    )


def last_backup_age(states: DataFrame, latest_exports: DataFrame, now: Column) -> DataFrame:
    """Newest successful run per source, or a newer completed export.

    ``states`` are current states, ``latest_exports`` newest exports: an older success behind a
    failed last run does not count.
    """
    ran = states.where(F.col("status").isin(*SUCCESS_STATUSES)).select(
        "source_alias", F.col("checked_at").alias("at")
    )
    exported = latest_exports.where(F.col("lane") == "completed").select(
        "source_alias", F.col("export_time").alias("at")
    )
    return (
        ran.unionByName(exported)
        .groupBy("source_alias")
        .agg(F.max("at").alias("last_backup_at"))
        .withColumn("last_backup_age_hours", age_hours(now, F.col("last_backup_at")))
    )


def latest_restore_point(states: DataFrame, strict: bool = False) -> DataFrame:
    """Oldest of the buckets' last good check times: all buckets are covered by it.

    Any state but failed counts; ``strict`` asks for a successful one.
    """
    status = F.col("status")
    good = status.isin(*SUCCESS_STATUSES) if strict else status != "failed"
    return (
        states.where(good & F.col("checked_at").isNotNull())
        .groupBy("source_alias")
        .agg(F.min("checked_at").alias("restore_point"), F.count("*").alias("buckets"))
    )


# --- events -----------------------------------------------------------------------------------


def filter_events(
    events: DataFrame, source: str | None = None, since: Column | None = None, time: str = "ts"
) -> DataFrame:
    """Events without a time pass only when no ``since`` is given."""
    if source is not None:
        events = events.where(F.col("source") == source)
    if since is not None:
        events = events.where(F.col(time) >= since)
    return events


def events_latest(events: DataFrame, n: int = EVENT_LIMIT, time: str = "ts") -> DataFrame:
    """Newest first, events without a time last."""
    return events.orderBy(F.desc_nulls_last(time), F.desc("event_id")).limit(n)


def event_summary_fields(events: DataFrame) -> DataFrame:
    details = F.col("details")
    return events.select(
        "event_id",
        "event_type",
        event_target(F.col("event_type"), details).alias("target"),
        F.coalesce(details_field(details, "status"), F.lit("?")).alias("status"),
        F.coalesce(details_field(details, "mode"), F.lit("")).alias("mode"),
        event_extent(details).alias("extent"),
    )


def event_fields(events: DataFrame) -> DataFrame:
    """Every event with the fields of its type, typed; a field that the type doesn't have is NULL.

    ``details`` is parsed once. Malformed details, and values of another type, give NULL fields; an event
    whose target can't be read has the target ``?``, one of a type without a target NULL.
    """
    kind, f = F.col("event_type"), lambda name: F.col(f"_d.{name}")

    def of(types: tuple[str, ...], value: Column) -> Column:
        return F.when(kind.isin(*types), value)

    run, complete, test = ("backup_run",), ("backup_run_complete",), ("test_restore",)
    submitted, restores = ("restore_submitted",), ("restore_submitted", "restore_completed")
    target = (
        F.when(kind.isin(*run), F.coalesce(f("bucket"), f("table"), F.lit("?")))
        .when(kind.isin(*test), F.coalesce(f("bucket"), F.lit("?")))
        .when(kind.isin(*restores), F.coalesce(f("dest_table"), F.lit("?")))
        .when(kind == "pitr_reenabled", F.coalesce(F.substring_index(f("table_arn"), "/", -1), F.lit("?")))
    )
    errors = F.coalesce(f("errors"), F.array().cast("array<string>"))
    return events.withColumn("_d", F.from_json("details", schemas.EVENT_DETAILS, {"mode": "PERMISSIVE"})).select(
        "event_type",
        "source",
        "ts",
        "actor",
        target.alias("target"),
        *[of(run, f(name)).alias(name) for name in (
            "status", "mode", "objects_copied", "objects_in_manifest", "bytes_transferred", "batch_job_id",
        )],
        of(run, F.substring_index(f("export_arn"), "/", -1)).alias("export_id"),
        *[of(submitted, f(name)).alias(name) for name in ("restore_point", "triggered_by")],
        *[of(complete, f(name)).alias(name) for name in ("success", "s3_buckets", "dynamodb_tables")],
        of(complete, F.size(errors)).cast("bigint").alias("error_count"),
        of(complete, F.array_join(errors, "; ")).alias("errors"),
        of(test, f("result")).alias("result"),
    )


def activity_report(events: DataFrame, now: Column, days: int, time: str = "ts") -> DataFrame:
    recent = F.col(time) >= now - F.make_dt_interval(days=F.lit(days))
    return (
        events.where(recent)
        .groupBy(F.to_date(time).alias("day"), "source", "event_type", "status")
        .agg(F.count("*").alias("events"))
    )


def metric_bins(points: DataFrame, by: str, time: str = "ts", value: str = "value") -> DataFrame:
    """Sums in 60 s bins."""
    return (
        points.groupBy(by, F.window(time, "60 seconds").alias("bin"))
        .agg(F.sum(value).alias("total"))
        .select(by, F.col("bin.start").alias("bin"), "total")
    )


def metric_window(
    points: DataFrame,
    now: Column,
    by: str,
    minutes: int = METRIC_WINDOW_MINUTES,
    time: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Trailing sum and time of the last bin with something in it."""
    start = now - F.make_dt_interval(mins=F.lit(minutes))
    inside = points.where((F.col(time) >= start) & (F.col(time) < now))
    return (
        metric_bins(inside, by, time, value)
        .groupBy(by)
        .agg(
            F.sum("total").alias("total"),
            F.max(F.when(F.col("total") > 0, F.col("bin"))).alias("last_nonzero_at"),
        )
    )


def owned(jobs: DataFrame, owners: DataFrame) -> DataFrame:
    """Jobs with the source that each bucket is configured for; those of unknown buckets have none and go."""
    return jobs.join(per_source(owners.select("source_alias", "bucket").distinct()), "bucket")


def source_status(
    registry: DataFrame,
    states: DataFrame,
    freshness: DataFrame,
    jobs: DataFrame,
    exports: DataFrame,
    owners: DataFrame,
) -> DataFrame:
    """One nested row per source: last runs, inventory times, recent jobs and exports.

    ``owners`` (source_alias, bucket) says whose a job's bucket is, whether it ever ran or not. ``jobs`` and ``exports`` are already cut to the newest few per bucket and table, and ``states``
    to one per bucket, so the collected arrays are as long as the configuration.
    """
    def nested(df: DataFrame, name: str, *fields: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(*fields)))
        return per_source(df.groupBy("source_alias").agg(rows.alias(name)))

    return (
        registry.select("source_alias")
        .distinct()
        .join(nested(states, "last_runs", "bucket", "checked_at", "status", "objects_copied"), "source_alias", "left")
        .join(per_source(freshness), "source_alias", "left")
        .join(
            nested(owned(jobs, owners), "recent_jobs", "bucket", "creation_time", "job_id", "status"),
            "source_alias", "left",
        )
        .join(
            nested(exports, "recent_exports", "table_name", "export_time", "export_arn", "status"),
            "source_alias", "left",
        )
    )


def explode_registry(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, bucket, label, backup bucket) rows and (alias, table) rows of the configuration."""
    from stowcheck.functions.keys import arn_bucket, arn_table, backup_bucket_name

    buckets = sources.select(
        "source_alias", "source_account_id", F.explode("s3_buckets").alias("b")
    ).select(
        "source_alias",
        arn_bucket(F.col("b.arn")).alias("source_bucket"),
        F.col("b.label").alias("label"),
        backup_bucket_name(
            F.col("source_alias"), F.col("b.label"), F.col("source_account_id")
        ).alias("backup_bucket"),
    )
    tables = sources.select("source_alias", F.explode("tables").alias("arn")).select(
        "source_alias", arn_table(F.col("arn")).alias("table_name"), F.col("arn").alias("table_arn")
    )
    return buckets, tables
