"""Table maintenance: applying a sync, pending restores, audit events, keyed reconciliation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowcheck.functions.objects import needs_copy_strict
from stowcheck.operators.toolkit import BUCKET, KEY, per_source


def _synced(source: DataFrame, backup: DataFrame, registry: DataFrame, full_sync: bool) -> DataFrame:
    """Both sides of every key as structs, its backup bucket, and whether the source row is copied."""
    fields = ["bucket", "size", "e_tag", "last_modified_date"]
    ours = source.select(*KEY, F.struct(*fields).alias("s"))
    copies = backup.select(*KEY, F.struct(*fields).alias("b"))
    copy = F.col("s").isNotNull() & needs_copy_strict(
        F.col("b").isNull(),
        F.col("s.size"),
        F.col("b.size"),
        F.col("s.e_tag"),
        F.col("b.e_tag"),
        full_sync,
    )
    pairs = per_source(registry.select(*BUCKET, "backup_bucket"))
    return ours.join(copies, KEY, "full").join(pairs, BUCKET, "left").withColumn("copied", copy)


def _new_row(run_at: Column) -> Column:
    return F.struct(
        F.coalesce("b.bucket", "backup_bucket").alias("bucket"),
        F.col("s.size").alias("size"),
        F.col("s.e_tag").alias("e_tag"),
        run_at.alias("last_modified_date"),
    )


def apply_sync(
    source: DataFrame, backup: DataFrame, registry: DataFrame, run_at: Column, full_sync: bool = False
) -> DataFrame:
    """The backup's next snapshot: copied rows replace or add; source deletes never propagate.

    ``registry`` (source_alias, label, backup_bucket) names the bucket that new rows go to.
    """
    row = F.when(F.col("copied"), _new_row(run_at)).otherwise(F.col("b"))
    return (
        _synced(source, backup, registry, full_sync)
        .select(*KEY, row.alias("row"), "copied")
        .select(*KEY, "row.*", "copied")
    )


def apply_sync_versions(
    source: DataFrame, backup: DataFrame, registry: DataFrame, run_at: Column, full_sync: bool = False
) -> DataFrame:
    """As ``apply_sync`` on a versioned bucket: an overwritten row stays as a non-current version.

    ``backup`` holds the current rows; one pass emits one or two rows per key.
    """
    kept = F.when(F.col("b").isNotNull(), F.struct("b.*", (~F.col("copied")).alias("is_latest")))
    written = F.when(
        F.col("copied"), F.struct(_new_row(run_at).alias("n")).getField("n")
    )
    new = F.when(written.isNotNull(), F.struct(
        written.bucket.alias("bucket"), written.size.alias("size"), written.e_tag.alias("e_tag"),
        written.last_modified_date.alias("last_modified_date"), F.lit(True).alias("is_latest"),
    ))
    return (
        _synced(source, backup, registry, full_sync)
        .select(*KEY, F.explode(F.array_compact(F.array(kept, new))).alias("row"))
        .select(*KEY, "row.*")
    )


def pending_restore_step(
    pending: DataFrame, table_status: DataFrame, registry: DataFrame
) -> DataFrame:
    """One watcher step: entries whose table is ACTIVE complete with two events, the rest stay.

    Entries of unregistered sources stay pending. ``record`` is ``remaining``, ``completed`` or an
    event type.
    """
    known = registry.select(F.col("source_alias").alias("source")).distinct()
    status = table_status.select("table_name", "table_status")
    done = F.coalesce(F.col("table_status") == "ACTIVE", F.lit(False)) & F.col("_known").isNotNull()
    records = F.when(
        done, F.array(*map(F.lit, ("completed", "restore_completed", "pitr_reenabled")))
    ).otherwise(F.array(F.lit("remaining")))
    details = F.when(
        F.col("record") == "restore_completed",
        F.to_json(
            F.struct(
                F.col("table_name").alias("dest_table"), "restore_arn", "source_table_arn",
                F.date_format("restore_point", "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("restore_point"),
            )
        ),
    ).when(
        F.col("record") == "pitr_reenabled", F.to_json(F.struct(F.col("restore_arn").alias("table_arn")))
    )
    return (
        pending.withColumn("table_name", F.substring_index("restore_arn", "/", -1))
        .join(status, "table_name", "left")
        .join(known.withColumn("_known", F.lit(True)), "source", "left")
        .select(
            "restore_arn", "source", "source_table_arn", "restore_point", "table_name",
            F.explode(records).alias("record"),
        )
        .select("restore_arn", "source", "record", details.alias("details"))
    )


def pending_by_source(pending: DataFrame, registry: DataFrame) -> DataFrame:
    known = registry.select(F.col("source_alias").alias("source")).distinct()
    return (
        pending.groupBy("source")
        .agg(
            F.count("*").alias("pending"),
            F.min("submitted_at").alias("oldest_submitted_at"),
        )
        .join(known.withColumn("_known", F.lit(True)), "source", "left")
        .select("source", "pending", "oldest_submitted_at", F.col("_known").isNotNull().alias("registered"))
    )


def run_events(bucket_results: DataFrame, table_results: DataFrame) -> DataFrame:
    """Audit events of a run: one per bucket and table result, one completion per source.

    ``bucket_results``: source, target, ts, status, objects. ``table_results``: source, target, ts,
    status. A source completes without success when any result failed.
    """
    def single(df: DataFrame, kind: str, objects: Column) -> DataFrame:
        return df.select("source", F.lit(kind).alias("kind"), "target", "ts", "status", objects.alias("objects"))

    results = single(bucket_results, "bucket", F.col("objects")).unionByName(
        single(table_results, "table", F.lit(None).cast("bigint"))
    )
    failed = F.lower("status") == "failed"
    completions = results.groupBy("source").agg(
        F.max("ts").alias("ts"),
        F.count_if(failed).alias("errors"),
        F.count_distinct(F.when(F.col("kind") == "bucket", F.col("target"))).alias("buckets"),
        F.count_distinct(F.when(F.col("kind") == "table", F.col("target"))).alias("tables"),
    )
    runs = results.select(
        F.lit("backup_run").alias("event_type"),
        "source",
        "ts",
        F.to_json(F.struct(
            F.when(F.col("kind") == "bucket", F.col("target")).alias("bucket"),
            F.when(F.col("kind") == "table", F.col("target")).alias("table"),
            F.lower("status").alias("status"),
            F.col("objects").alias("objects_copied"),
        )).alias("details"),
    )
    complete = completions.select(
        F.lit("backup_run_complete").alias("event_type"),
        "source",
        "ts",
        F.to_json(F.struct(
            (F.col("errors") == 0).alias("success"),
            F.col("buckets").alias("s3_buckets"),
            F.col("tables").alias("dynamodb_tables"),
            "errors",
        )).alias("details"),
    )
    return runs.unionByName(complete)


def set_reconcile(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Actions that make ``current`` equal ``desired``; endpoints compare trimmed, without case.

    Pending ones are neither added again nor removed. One aggregation over both sides instead of an
    outer join, so repeated endpoints meet before the shuffle.
    """
    endpoint = F.lower(F.btrim("endpoint"))
    unconfirmed = F.col("arn") == "PendingConfirmation"
    wanted = desired.select(
        endpoint.alias("endpoint"),
        F.lit(True).alias("wanted"),
        F.lit(False).alias("confirmed"),
        F.lit(False).alias("waiting"),
        F.lit(None).cast("string").alias("arn"),
    )
    present = current.select(
        endpoint.alias("endpoint"),
        F.lit(False).alias("wanted"),
        (~unconfirmed).alias("confirmed"),
        unconfirmed.alias("waiting"),
        F.when(~unconfirmed, F.col("arn")).alias("arn"),
    )
    wanted_, confirmed, waiting = map(F.col, ("wanted", "confirmed", "waiting"))
    actions = F.array_compact(
        F.array(
            F.when(wanted_ & ~confirmed & ~waiting, "to_add"),
            F.when(~wanted_ & confirmed, "to_remove"),
            F.when(wanted_ & waiting, "pending"),
            F.when(wanted_ & confirmed, "kept"),
        )
    )
    return (
        wanted.unionByName(present)
        .where(F.col("endpoint") != "")
        .groupBy("endpoint")
        .agg(
            F.bool_or("wanted").alias("wanted"),
            F.bool_or("confirmed").alias("confirmed"),
            F.bool_or("waiting").alias("waiting"),
            F.max("arn").alias("arn"),
        )
        .select("endpoint", F.explode(actions).alias("action"), "arn")
        .select(
            "endpoint",
            "action",
            F.when(F.col("action") == "to_remove", F.col("arn")).alias("arn"),
        )
    )


def run_log(results: DataFrame, actor: str) -> DataFrame:
    """Events of finished runs for the event log, with all that the run knows about each result.

    ``results``: run_id, source, kind (bucket or table), target, ts, status, mode, objects_copied,
    bytes_transferred, batch_job_id, objects_in_manifest, export_arn, error. Each result without an error is a
    ``backup_run``; a result with one shows in the errors of its run only. A run completes once per source,
    successfully without errors. A run has as many results as its source has buckets and tables, so its
    errors are a short list; NULL fields are left out of the details.
    """
    is_bucket, failed = F.col("kind") == "bucket", F.col("error").isNotNull()
    names = ("status", "mode", "objects_copied", "bytes_transferred", "batch_job_id", "objects_in_manifest", "export_arn")
    single = results.where(~failed).select(
        F.lit("backup_run").alias("event_type"),
        "source",
        "ts",
        F.to_json(F.struct(
            F.when(is_bucket, F.col("target")).alias("bucket"), F.when(~is_bucket, F.col("target")).alias("table"), *names
        )).alias("details"),
    )
    whole = results.groupBy("source", "run_id").agg(
        F.max("ts").alias("ts"),
        (F.count_if(failed) == 0).alias("success"),
        F.count_distinct(F.when(is_bucket, F.col("target"))).alias("s3_buckets"),
        F.count_distinct(F.when(~is_bucket, F.col("target"))).alias("dynamodb_tables"),
        F.array_sort(F.collect_list(F.concat("target", F.lit(": "), "error"))).alias("errors"),
    ).select(
        F.lit("backup_run_complete").alias("event_type"),
        "source",
        "ts",
        F.to_json(F.struct("success", "s3_buckets", "dynamodb_tables", "errors")).alias("details"),
    )
    return single.unionByName(whole).withColumn("actor", F.lit(actor))
