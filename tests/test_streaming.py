import pytest
from pyspark.sql import functions as F

from conftest import SF
from stowcheck.streaming import jobs


def feed(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(path))


def write(path, name, lines):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")


ENTRY = '{"table_name":"%s","restore_arn":"arn/%s","source":"a","submitted_at":"2024-01-%sT00:00:00Z"}'
STATUS = '{"table_name":"%s","table_status":"%s","reported_at":"2024-01-%sT00:30:00Z"}'


def restores(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = feed(
        spark, source,
        "table_name string, restore_arn string, source string, submitted_at timestamp, table_status string, reported_at timestamp",
    )
    stream = jobs.completed_restores(
        rows.where("restore_arn IS NOT NULL").select("table_name", "restore_arn", "source", "submitted_at"),
        rows.where("table_status IS NOT NULL").select("table_name", "table_status", "reported_at"),
    )
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def emitted():
        query = jobs.run_to_end(stream, out, ck, timeout_seconds=120)
        rows = sorted((r.table_name, r.event_type) for r in spark.read.parquet(out).collect())
        return rows, sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])

    return source, stream, emitted


def both(table):
    return [(table, "pitr_reenabled"), (table, "restore_completed")]


def test_restore_completes_once_across_batches(spark, tmp_path):
    source, _, emitted = restores(spark, tmp_path)
    write(source, "1.json", [ENTRY % ("t1", "t1", "01"), ENTRY % ("t2", "t2", "01"), STATUS % ("t1", "CREATING", "01"), STATUS % ("t3", "ACTIVE", "01")])
    assert emitted()[0] == []
    # the status was known before the entry for t3; t1 is reported and entered twice
    write(source, "2.json", [STATUS % ("t1", "ACTIVE", "02"), STATUS % ("t1", "ACTIVE", "02"), ENTRY % ("t1", "t1", "01"), ENTRY % ("t3", "t3", "01")])
    assert emitted()[0] == both("t1") + both("t3")
    write(source, "3.json", [STATUS % ("t1", "ACTIVE", "03"), STATUS % ("t2", "CREATING", "03")])
    assert emitted()[0] == both("t1") + both("t3")


def test_restore_state_expires(spark, tmp_path):
    source, stream, emitted = restores(spark, tmp_path)
    plan = stream._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    write(source, "1.json", [ENTRY % (f"t{i}", f"t{i}", "01") for i in range(50)] + [STATUS % (f"t{i}", "ACTIVE", "01") for i in range(50)])
    rows, held = emitted()
    assert len(rows) == 100 and held >= 100
    # weeks later: what was kept for repeated reports is gone, a restore never reported ACTIVE too
    write(source, "2.json", [ENTRY % ("late", "late", "28"), STATUS % ("late", "ACTIVE", "28")])
    rows, held = emitted()
    assert len(rows) == 102
    write(source, "3.json", [ENTRY % ("later", "later", "29"), STATUS % ("later", "CREATING", "29")])
    rows, held = emitted()
    assert len(rows) == 102 and held < 20


def test_duplicates_and_late_bins(spark, tmp_path):
    source = tmp_path / "in"
    line = '{"event_id":%d,"ts":"2024-01-01T%s:00Z","name":"m","value":%s}'
    write(source, "1.json", [line % (1, "00:00", 1), line % (1, "00:00", 1), line % (2, "05:00", 2), line % (3, "09:00", 0)])
    rows = feed(spark, source, "event_id long, ts timestamp, name string, value double")
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.deduplicated_events(rows), out, str(tmp_path / "ck"), partition="month", timeout_seconds=120)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    spans = str(tmp_path / "spans")
    jobs.run_to_end(jobs.metric_windows(rows, "name", slide="120 minutes"), spans, str(tmp_path / "ck2"), timeout_seconds=120)
    got = {str(r.start)[11:16]: r.total for r in spark.read.parquet(spans).collect()}
    # 08:00-10:00 is still open: the watermark stands at 08:00
    assert got == {"00:00": 2.0, "04:00": 2.0}


def test_staleness_lanes(spark, tmp_path):
    source = tmp_path / "in"
    line = '{"bucket":"%s","ts":"2024-01-%s:00:00Z","status":"%s"}'
    write(source, "1.json", [
        line % ("a", "01T00", "completed"), line % ("a", "01T06", "skipped"), line % ("a", "01T20", "failed"),
        line % ("a", "02T06", "submitted"), line % ("b", "01T00", "completed"), line % ("b", "09T00", "completed"),
    ])
    rows = feed(spark, source, "bucket string, ts timestamp, status string")
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.staleness(rows, "bucket"), out, str(tmp_path / "ck"), timeout_seconds=120)
    got = sorted((r.bucket, r.level, str(r.stale_at)[5:16], r.successes) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", "red", "01-03 18:00", 3), ("a", "yellow", "01-01 18:00", 2), ("a", "yellow", "01-02 18:00", 1),
        ("b", "red", "01-02 12:00", 1), ("b", "yellow", "01-01 12:00", 1),
    ]


def test_alarms(spark):
    rows = [(1, '{"AlarmName":"n","NewStateValue":"ALARM","NewStateReason":"%s"}' % ("r" * 2000)), (2, "plain text"),
            (3, '{"other":1}'), (4, '{"AlarmName":"m"}'), (5, '{"AlarmName":"q","NewStateValue":"ODD"}')]
    df = spark.createDataFrame(rows, "event_id long, message string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r.event_id: (r.title, r.severity, len(r.reason)) for r in jobs.delivered_alarms(df).collect()}
    assert got == {1: ("n → ALARM", "red", 1024), 4: ("m → (unknown)", "blue", 0), 5: ("q → ODD", "blue", 0)}
    assert jobs.alarm_counts(df).collect()[0].asDict() == {"delivered": 3, "skipped": 2}


@pytest.mark.parametrize("files", [1, 3])
def test_file_stream_reads_a_table_of_one_or_many_files(spark, tmp_path, files):
    events = spark.read.parquet(f"{SF}/events.parquet")
    if files == 1:
        folder = SF
    else:
        folder = str(tmp_path / "sf")
        events.repartition(files).write.parquet(f"{folder}/events.parquet")
    out = str(tmp_path / "out")
    jobs.run_to_end(jobs.file_stream(spark, folder, "events"), out, str(tmp_path / "ck"), timeout_seconds=120)
    assert spark.read.parquet(out).count() == events.count() > 0


def test_silent_sources_are_reported_by_the_heartbeats_of_others(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = '{"bucket":"%s","ts":"2024-01-%s:00:00Z","registered":%s,"succeeded":%s}'
    rows = feed(spark, source, "bucket string, ts timestamp, registered boolean, succeeded boolean")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def reported():
        jobs.run_to_end(jobs.silent_sources(rows, "bucket"), out, ck, timeout_seconds=120)
        return sorted((r.bucket, r.level, str(r.stale_at)[5:13], r.successes, r.last_success_at and str(r.last_success_at)[5:13]) for r in spark.read.parquet(out).collect())

    # "never" only registers; "once" succeeds and falls silent; failures (no flag) don't count
    write(source, "1.json", [
        line % ("never", "01T00", "true", "false"), line % ("once", "01T00", "true", "null"), line % ("once", "01T06", "null", "true"),
        line % ("once", "01T10", "false", "false"), line % ("never", "01T09", "null", "null"),
    ])
    assert reported() == []
    # only another source writes: its heartbeat reports both, once each
    write(source, "2.json", [line % ("other", "01T20", "false", "false")])
    yellow = [("never", "yellow", "01-01 12", 0, None), ("once", "yellow", "01-01 18", 1, "01-01 06")]
    assert reported() == yellow
    write(source, "3.json", [line % ("other", "01T21", "null", "null")])
    assert reported() == yellow
    write(source, "4.json", [line % ("other", "02T20", "false", "false")])
    red = [("never", "red", "01-02 12", 0, None), ("once", "red", "01-02 18", 1, "01-01 06")]
    assert reported() == sorted(yellow + red)
