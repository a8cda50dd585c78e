from datetime import datetime

from pyspark.sql import functions as F

from stowcheck.operators import cost, maintenance, operations
from stowcheck.sources.fixtures import Fixtures

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_current_state_and_restore_point(spark):
    rows = [
        ("a", "b1", at(1), "completed", 1), ("a", "b1", at(3), "failed", 2),
        ("a", "b2", at(2), "running", 3), ("a", "b3", at(4), "submitted", 4),
        ("c", "b4", at(5), "failed", 5),
    ]
    states = operations.current_run_state(
        spark.createDataFrame(rows, "source_alias string, bucket string, checked_at timestamp, status string, event_id long")
    )
    assert {r.bucket: r.status for r in states.collect()} == {"b1": "failed", "b2": "running", "b3": "submitted", "b4": "failed"}
    loose = operations.latest_restore_point(states).collect()
    assert [(r.source_alias, r.restore_point, r.buckets) for r in loose] == [("a", at(2), 2)]
    strict = operations.latest_restore_point(states, strict=True).collect()
    assert [(r.restore_point, r.buckets) for r in strict] == [(at(4), 1)]
    # an older success behind a failed last run does not count
    none = spark.createDataFrame([], "source_alias string, lane string, export_time timestamp")
    ages = operations.last_backup_age(states, none, now()).collect()
    assert [(r.source_alias, r.last_backup_at) for r in ages] == [("a", at(4))]
    newer = spark.createDataFrame([("a", "completed", at(9)), ("a", "failed", at(10))], none.schema)
    ages = operations.last_backup_age(states, newer, now()).collect()
    assert (ages[0].last_backup_at, ages[0].last_backup_age_hours) == (at(9), 23 * 24.0)


def test_export_lanes(spark):
    rows = [
        ("e1", "t1", "a", "COMPLETED", at(1)), ("e2", "t1", "a", "FAILED", at(2)),
        ("e3", "t2", "a", "in_progress", at(1)), ("e4", "t3", "a", "OTHER", at(1)), ("e5", "t5", "a", None, at(1)),
    ]
    exports = spark.createDataFrame(rows, "export_arn string, table_name string, source_alias string, status string, export_time timestamp")
    tables = spark.createDataFrame([("a", f"t{i}") for i in range(1, 6)], "source_alias string, table_name string")
    row = operations.export_summary(operations.latest_export(exports, tables)).collect()[0]
    assert row.asDict() == {"source_alias": "a", "completed": 0, "in_progress": 1, "failed": 1, "no_recent": 2, "errored": 1}
    done = {r.table_name: (r.completed, r.failed) for r in operations.latest_completed_export(exports, tables).collect()}
    assert done["t1"] == (1, False) and done["t4"] == (0, True)


def test_job_progress_and_failure_rate(spark):
    rows = [
        ("j1", "b", "backup: x → b", at(1), "Complete", 8, 0, 0),
        ("j2", "b", "backup: x → b", at(2), "Active", 16, 1, 1),
        ("j3", "c", "restore: x → c", at(1), "New", 0, 0, 0),
    ]
    jobs = spark.createDataFrame(
        rows, "job_id string, bucket string, description string, creation_time timestamp, status string, total_tasks long, tasks_failed long, tasks_succeeded long"
    )
    got = {r.job_id: (r.succeeded, r.done, r.percent_complete) for r in operations.job_progress(jobs).collect()}
    # 12.5 and, at one decimal, ties go to the even digit
    assert got == {"j1": (8, 8, 100.0), "j2": (1, 2, 12.5), "j3": (0, 0, 0.0)}
    rates = {r.bucket: (r.job_id, r.failure_pct, r.alarming) for r in operations.job_failure_rate(jobs).collect()}
    assert rates == {"b": ("j2", 0.0625, False), "c": ("j3", 0.0, False)}
    assert [r.job_id for r in operations.recent_jobs(jobs, kind="restore").collect()] == ["j3"]


def test_events_order_and_filter(spark):
    rows = [(1, at(1), "a"), (2, None, "a"), (3, at(3), "b"), (4, at(3), "a")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, source string")
    assert [r.event_id for r in operations.events_latest(events).collect()] == [4, 3, 1, 2]
    kept = operations.filter_events(events, "a", F.lit("2024-01-02").cast("timestamp"))
    assert [r.event_id for r in kept.collect()] == [4]
    assert operations.filter_events(events).count() == 4


def test_metric_window_without_values(spark):
    rows = [("m", datetime(2024, 1, 31, 23, 30, 5), 0.0), ("m", datetime(2024, 1, 31, 23, 10), 2.0), ("m", datetime(2024, 1, 31, 20), 5.0), ("z", datetime(2024, 1, 31, 23), 0.0)]
    points = spark.createDataFrame(rows, "name string, ts timestamp, value double")
    got = {r.name: (r.total, r.last_nonzero_at) for r in operations.metric_window(points, now(), "name").collect()}
    assert got == {"m": (2.0, datetime(2024, 1, 31, 23, 10)), "z": (0.0, None)}


def test_set_reconcile(spark):
    desired = spark.createDataFrame([(" New@x ",), ("keep@x",), ("wait@x",), ("both@x",), ("  ",)], "endpoint string")
    current = spark.createDataFrame(
        [("KEEP@x", "arn1"), ("old@x", "arn2"), ("Wait@x", "PendingConfirmation"), ("gone@x", "PendingConfirmation"),
         ("both@x", "arn3"), ("both@x", "PendingConfirmation")],
        "endpoint string, arn string",
    )
    got = {(r.endpoint, r.action, r.arn) for r in maintenance.set_reconcile(desired, current).collect()}
    assert got == {
        ("new@x", "to_add", None), ("keep@x", "kept", None), ("wait@x", "pending", None),
        ("old@x", "to_remove", "arn2"), ("both@x", "kept", None), ("both@x", "pending", None),
    }


SIDE = "source_alias string, bucket string, label string, key string, size long, e_tag string, last_modified_date timestamp"


def test_apply_sync_keeps_deleted_and_versions(spark):
    registry = spark.createDataFrame([("a", "main", "bk")], "source_alias string, label string, backup_bucket string")
    source = spark.createDataFrame([("a", "src", "main", "new", 1, "x", at(1)), ("a", "src", "main", "chg", 2, "y", at(1)), ("a", "src", "main", "same", 3, "z", at(1))], SIDE)
    backup = spark.createDataFrame([("a", "bk", "main", "chg", 2, "old", at(1)), ("a", "bk", "main", "same", 3, "z", at(1)), ("a", "bk", "main", "deleted", 4, "d", at(1))], SIDE)
    got = {r.key: (r.e_tag, r.last_modified_date, r.copied) for r in maintenance.apply_sync(source, backup, registry, F.lit(at(9))).collect()}
    assert got == {"new": ("x", at(9), True), "chg": ("y", at(9), True), "same": ("z", at(1), False), "deleted": ("d", at(1), False)}
    versions = {(r.key, r.e_tag, r.is_latest) for r in maintenance.apply_sync_versions(source, backup, registry, F.lit(at(9))).collect()}
    assert versions == {("new", "x", True), ("chg", "old", False), ("chg", "y", True), ("same", "z", True), ("deleted", "d", True)}


def test_pending_restore_step(spark):
    arn = "arn:aws:dynamodb:r:1:table/"
    pending = spark.createDataFrame(
        [(arn + "t1", "a", "", at(1), at(1)), (arn + "t2", "a", "", at(1), at(1)), (arn + "t3", "gone", "", at(1), at(1)), (arn + "t4", "a", "", at(1), at(2))],
        "restore_arn string, source string, source_table_arn string, restore_point timestamp, submitted_at timestamp",
    )
    status = spark.createDataFrame([("t1", "ACTIVE"), ("t2", "CREATING"), ("t3", "ACTIVE")], "table_name string, table_status string")
    registry = spark.createDataFrame([("a",)], "source_alias string")
    got = sorted((r.restore_arn[-2:], r.record) for r in maintenance.pending_restore_step(pending, status, registry).collect())
    assert got == [("t1", "completed"), ("t1", "pitr_reenabled"), ("t1", "restore_completed"), ("t2", "remaining"), ("t3", "remaining"), ("t4", "remaining")]
    by_source = {r.source: (r.pending, r.registered) for r in maintenance.pending_by_source(pending, registry).collect()}
    assert by_source == {"a": (3, True), "gone": (1, False)}


def test_cost_model(spark):
    gb = 1024**3
    rows = [("a", "STANDARD", 100 * gb), ("a", "GLACIER_IR", 8000 * gb), ("b", "GLACIER_IR", 2000 * gb), ("c", "STANDARD", gb)]
    tiered = spark.createDataFrame(rows, "source_alias string, tier string, size long")
    costs = {(r.source_alias, r.tier): round(r.monthly_nzd, 6) for r in cost.storage_cost(tiered).collect()}
    assert costs[("a", "STANDARD")] == 3.6 and costs[("a", "GLACIER_IR")] == 56.0
    levels = {r.source_alias: r.approval for r in cost.retrieval_cost(tiered).collect()}
    assert levels == {"a": "dual", "b": "single", "c": "none"}
    counts = spark.createDataFrame([("a", 8_000_000), ("b", 0)], "source_alias string, objects long")
    assert {r.source_alias: r.fee_usd for r in cost.batch_fee(counts).collect()} == {"a": 8.25, "b": 0.0}


def test_tiering_floor(spark):
    # 8 TB of large objects; the published projection is 34.49 for storage
    large = spark.range(8192).selectExpr("'big' AS source_alias", f"{1024**3}L AS size")
    small = spark.range(100).selectExpr("'small' AS source_alias", "1L AS size")
    got = {r.source_alias: r for r in cost.tiering_delta(large.union(small)).collect()}
    assert round(got["big"].standard_usd, 2) == 204.80
    assert round(got["big"].tiered_usd - 8192 / 1000 * 0.0025, 2) == 34.49
    assert got["small"].billed_bytes == 100 * 131072 and got["small"].saving_usd < 0


def test_jobs_belong_to_configured_buckets(spark):
    jobs = spark.createDataFrame(
        [("ran", "j1", "Failed", 10, 5, at(2)), ("never-ran", "j2", "Failed", 10, 9, at(3)), ("unknown", "j3", "Failed", 10, 9, at(3))],
        "bucket string, job_id string, status string, total_tasks long, tasks_failed long, creation_time timestamp",
    )
    owners = spark.createDataFrame([("a", "ran"), ("a", "never-ran"), ("a", "ran"), ("b", "idle")], "source_alias string, bucket string")
    rates = operations.owned(operations.job_failure_rate(jobs), owners).collect()
    assert sorted((r.source_alias, r.bucket, r.failure_pct) for r in rates) == [("a", "never-ran", 0.9), ("a", "ran", 0.5)]


RESULT = (
    "run_id string, source string, kind string, target string, ts timestamp, status string, mode string, objects_copied long, "
    "bytes_transferred long, batch_job_id string, objects_in_manifest long, export_arn string, error string"
)


def test_run_log_and_its_fields(spark):
    at = datetime(2024, 1, 1, 3)
    rows = [
        ("r1", "a", "bucket", "b1", at, "submitted", "batch", None, None, "j1", 0, None, None),
        ("r1", "a", "bucket", "b2", at, "completed", "incremental", 5, 2**40, None, None, None, None),
        ("r1", "a", "bucket", "b3", at, None, "incremental", None, None, None, None, None, 'no "list"'),
        ("r1", "a", "table", "t1", at, "submitted", None, None, None, None, None, "arn:x/table/t1/export/e9", None),
        ("r2", "a", "bucket", "b1", at, "skipped", "incremental", 0, 0, None, None, None, None),
    ]
    log = maintenance.run_log(spark.createDataFrame(rows, RESULT), "me")
    assert log.where("details LIKE '%b3%' AND event_type = 'backup_run'").count() == 0
    fields = operations.event_fields(log).collect()
    assert len(fields) == 6 and all(r.actor == "me" for r in fields)
    batch = next(r for r in fields if r.batch_job_id)
    assert (batch.target, batch.mode, batch.batch_job_id, batch.objects_in_manifest, batch.objects_copied) == ("b1", "batch", "j1", 0, None)
    got = {(r.event_type, r.target, r.success): r for r in fields}
    b2, t1 = got["backup_run", "b2", None], got["backup_run", "t1", None]
    assert (b2.objects_copied, b2.bytes_transferred, b2.mode, b2.batch_job_id) == (5, 2**40, "incremental", None)
    assert (t1.export_id, t1.mode, t1.error_count) == ("e9", None, None)
    bad, good = got["backup_run_complete", None, False], got["backup_run_complete", None, True]
    assert (bad.s3_buckets, bad.dynamodb_tables, bad.error_count, bad.errors) == (3, 1, 1, 'b3: no "list"')
    assert (good.s3_buckets, good.dynamodb_tables, good.error_count, good.errors) == (1, 0, 0, "")


def test_event_fields_of_odd_details(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "backup_run", '{"bucket":"b","objects_copied":"many","status":"x"}'), (2, "backup_run", "{broken"), (3, "backup_run", None),
            (4, "pitr_reenabled", '{"table_arn":"arn:x/table/t"}'), (5, "pitr_reenabled", "{}"), (6, "note", '{"bucket":"b","status":"s"}'),
            (7, "test_restore", '{"bucket":"b","result":"pass","status":"s"}'), (8, None, "{}"),
            (9, "restore_submitted", '{"dest_table":"d","restore_point":"2024-01-01T02:00:00Z","triggered_by":"me"}'),
            (10, "backup_run_complete", '{"success":true,"s3_buckets":2,"dynamodb_tables":0}')]
    df = spark.createDataFrame([(str(n), kind, at, "actor", details) for n, kind, details in rows], "source string, event_type string, ts timestamp, actor string, details string")
    got = {int(r.source): r for r in operations.event_fields(df).collect()}
    assert (got[1].target, got[1].objects_copied) == ("b", None)
    assert [got[n].target for n in (2, 3, 4, 5, 6, 7, 8)] == ["?", "?", "t", "?", None, "b", None]
    assert (got[6].status, got[7].status, got[7].result, got[9].triggered_by, str(got[9].restore_point)) == (None, None, "pass", "me", "2024-01-01 02:00:00")
    assert (got[10].success, got[10].s3_buckets, got[10].error_count, got[10].errors) == (True, 2, 0, "")


def test_every_run_is_a_state(spark, tmp_path):
    rows = [(i, at(1 + i % 9), 18 + i % 3, ("view", "click", "purchase")[i % 3]) for i in range(36)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    states = Fixtures(spark, str(tmp_path)).run_states
    assert sorted(r.event_id for r in states.collect()) == [i for i in range(36) if i % 3 != 2]
    last = operations.current_run_state(states).collect()
    assert {r.bucket: r.event_id for r in last} == {"bb-18": 33, "bb-19": 34}
    points = {r.source_alias: r.buckets for r in operations.latest_restore_point(states.withColumn("status", F.lit("completed"))).collect()}
    assert points == {"charlie": 12, "delta": 12}
