import time
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stowcheck.operators import reconcile, snapshots
from stowcheck.session import work_root
from stowcheck.sources import events, inventory, sinks
from stowcheck.sources.fixtures import TODAY, YESTERDAY, Fixtures


def test_partitioned_inventory_prunes_and_keeps_dt_text(spark, fx, tmp_path, plan_of):
    path = str(tmp_path / "inv")
    blank = F.lit(None).cast("string")
    inventory.write_inventory(fx.inventory.withColumns({"version_id": blank, "checksum_algorithm": blank}), path)
    stored = inventory.read_inventory(spark, path)
    assert dict(stored.dtypes)["dt"] == "string" and stored.count() == fx.inventory.count()
    one = snapshots.snapshot(stored, "alpha", "backup", TODAY).where(F.col("key").startswith("models/")).select("size")
    plan = plan_of(one)
    assert "StringStartsWith(key,models/)" in plan and "ReadSchema: struct<key:string,size:bigint>" in plan
    assert "PartitionFilters: [isnotnull(dt" in plan
    known = {tuple(r) for r in inventory.stored_partitions(spark, path).select("source_alias", "side", "dt").collect()}
    assert known == {tuple(r) for r in fx.inventory.select("source_alias", "side", "dt").distinct().collect()}
    latest = snapshots.at_latest(stored, fx.catalogue).select("key")
    assert "dynamicpruning" in plan_of(latest)
    listed = inventory.list_files(spark, path, "*.parquet")
    assert listed.where("size <= 0").count() == 0 and listed.count() > 0


def test_bucketed_reconciliation_needs_no_shuffle(spark, fx, plan_of, request):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    request.addfinalizer(lambda: spark.conf.set(threshold, before))
    spark.conf.set(threshold, "-1")
    source, backup = snapshots.source_side(fx.inventory, TODAY), snapshots.backup_side(fx.inventory, TODAY)
    for df in (
        reconcile.inventory_diff(source, backup),
        reconcile.missing_keys(source, backup),
        reconcile.key_sides(fx.inventory, TODAY),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and " Sort [" not in plan


def test_hot_groups_are_cut_before_the_shuffle(fx, plan_of):
    from stowcheck.operators import operations, restore

    for df in (operations.recent_jobs(fx.jobs), restore.sample_restore_hash(snapshots.backup_side(fx.inventory, TODAY))):
        plan = plan_of(df)
        assert plan.index("Final") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_manifest_roundtrip_parts_and_empty(spark, tmp_path):
    rows = [("a", "src", f"d/{i}%2C") for i in range(50)] + [("b", "src", "x")]
    manifest = spark.createDataFrame(rows, "source_alias string, bucket string, key string")
    path = str(tmp_path / "m")
    assert sinks.write_manifest(manifest.repartition(3), path) == 51
    stored = sinks.read_manifest(spark, path)
    assert {tuple(r) for r in stored.select("source_alias", "bucket", "key").collect()} == set(rows)
    lines = spark.read.text(path + "/source_alias=a")
    assert lines.count() == 50 and lines.where("value like '%\"%'").count() == 0
    parts = sinks.manifest_parts(stored).groupBy("source_alias").agg(F.sum("rows"), F.sum("bytes")).collect()
    assert {r[0]: (r[1], r[2]) for r in parts}["b"] == (1, len("src,x\n"))
    empty = str(tmp_path / "none")
    assert sinks.write_manifest(manifest.where("false"), empty) == 0
    assert not list((tmp_path / "none").rglob("*.csv"))


def test_event_log_skips_bad_lines_and_prunes_months(spark, tmp_path, plan_of):
    folder = tmp_path / "log" / "month=2024-01"
    folder.mkdir(parents=True)
    (folder / "events.jsonl").write_text(
        '{"event_id":1,"event_type":"backup_run","source":"a","timestamp":"2024-01-05T00:00:00+00:00","details":{"bucket":"b","n":1}}\n'
        "\n"
        "not json\n"
        '{"event_id":2,"event_type":"x","source":"a","timestamp":"2024-01-05T13:00:00+13:00","details":{},"actor":"me"}\n'
    )
    more = spark.createDataFrame([(3, "y", "b", None, "{}", None)], "event_id long, event_type string, source string, t string, details string, actor string")
    more = more.withColumn("timestamp", F.lit("2024-03-01 00:00:00.123456").cast("timestamp")).drop("t")
    root = str(tmp_path / "log")
    events.append_event_log(more, root)
    events.append_event_log(more.withColumn("event_id", F.lit(4).cast("long")), root)
    log = events.read_event_log(spark, root)
    got = {r.event_id: r for r in log.collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].details == '{"bucket":"b","n":1}' and got[2].actor == "me"
    assert got[3].timestamp.microsecond == 123456
    now = F.lit("2024-02-10 00:00:00").cast("timestamp")
    assert {r.event_id for r in events.in_months(log, now).collect()} == {1, 2}
    since = F.lit("2024-01-05 00:00:00").cast("timestamp")
    later = F.lit("2024-03-10 00:00:00").cast("timestamp")
    wanted = events.in_months(log, later, since)
    assert {r.event_id for r in wanted.collect()} == {1, 2, 3, 4}
    assert "month#" in plan_of(wanted).split("PartitionFilters: [")[1].split("]")[0]


def test_union_months_fills_missing_columns(spark):
    old = spark.createDataFrame([(1,)], "event_id long")
    new = spark.createDataFrame([(2, "me")], "event_id long, actor string")
    assert {tuple(r) for r in events.union_months([old, new]).collect()} == {(1, None), (2, "me")}


def test_export_and_restore_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(5)
    row = sinks.export_table_snapshot(df, str(tmp_path), "things", "2024-01-31").collect()[0]
    assert (row.export_prefix, row.rows) == ("things/2024/01/31", 5)
    with pytest.raises(AnalysisException):
        sinks.export_table_snapshot(df, str(tmp_path), "things", "2024-01-31")
    target = sinks.restore_to_new_table(df, str(tmp_path), "t")
    assert target.endswith("/t-restore")
    with pytest.raises(AnalysisException):
        sinks.restore_to_new_table(df, str(tmp_path), "t")
    sinks.restore_to_new_table(spark.range(2), str(tmp_path), "t", force=True)
    assert spark.read.parquet(target).count() == 2


def test_job_report(spark, tmp_path):
    from stowcheck.operators.operations import failed_tasks

    (tmp_path / "r.csv").write_text('"b","k%2C1","","failed","403","AccessDenied","x, y"\n"b","k2","","succeeded","200","200",""\n')
    report = sinks.read_job_report(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in failed_tasks(report).collect()] == [("b", "403", 1)]


def test_work_folder_comes_from_the_session(spark, monkeypatch):
    from stowcheck import session

    class Settings:
        def get(self, name, default):
            return "hdfs://shared/ck/" if name == "spark.checkpoint.dir" else default

    class Fake:
        conf = Settings()

    assert session.work_path(Fake(), "x").startswith("hdfs://shared/ck/x-")

    class Unset(Settings):
        def get(self, name, default):
            return default

    class Cluster:
        conf = Unset()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        session.work_root(Cluster())


def _bytes(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_stored_objects_stay_near_the_size_of_their_input(spark, tmp_path):
    items = spark.range(60000).selectExpr(
        "id DIV 4 AS l_orderkey", "abs(hash(id, 1)) % 20000 AS l_partkey", "abs(hash(id, 2)) % 1000 AS l_suppkey",
        "CAST(id % 4 AS int) AS l_linenumber", "CAST(abs(hash(id, 3)) % 50 AS double) AS l_quantity", "rand(1) AS l_extendedprice",
        "TIMESTAMP '1998-01-01 00:00:00' + make_dt_interval(abs(hash(id, 4)) % 2500) AS l_shipdate",
    )
    items.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = _bytes(work_root(spark))
    own = Fixtures(spark, str(tmp_path))
    assert own.checksums.count() == 2 * own.objects.count() and own.live.count() > 0 and own.inventory.count() > 180000
    assert _bytes(work_root(spark)) - before < 6 * _bytes(tmp_path)


def test_queries_that_match_no_keys_store_nothing(spark, tmp_path):
    from __spark_entry__ import queries

    spark.range(4000).selectExpr(
        "id DIV 4 AS l_orderkey", "abs(hash(id, 1)) % 200 AS l_partkey", "abs(hash(id, 2)) % 100 AS l_suppkey", "CAST(id % 4 AS int) AS l_linenumber",
        "CAST(id % 50 AS double) AS l_quantity", "TIMESTAMP '1998-01-01 00:00:00' AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = _bytes(work_root(spark))
    for name in ("filter_current_version", "filter_operational", "filter_nonempty", "lifecycle_tier", "cost_breakdown", "filter_partition", "count_delta"):
        assert queries()[name](spark, str(tmp_path)).count() > 0
    # one row per snapshot for the deliveries and the counts, no row of an object
    assert _bytes(work_root(spark)) - before < 20_000
    own = Fixtures(spark, str(tmp_path))
    for listed, stored in ((own.listed, own.inventory), (own.listed_live, own.live), (own.listed_checksums, own.checksums)):
        assert listed.exceptAll(stored).isEmpty() and stored.exceptAll(listed).isEmpty()


def _items(spark, n):
    return spark.range(n).selectExpr(
        "id DIV 4 AS l_orderkey", "abs(hash(id, 1)) % 200 AS l_partkey", "abs(hash(id, 2)) % 100 AS l_suppkey", "CAST(id % 4 AS int) AS l_linenumber",
        "CAST(id % 50 AS double) AS l_quantity", "TIMESTAMP '1998-01-01 00:00:00' AS l_shipdate",
    )


def test_a_day_is_stored_when_it_is_first_read_and_its_shuffle_goes(spark, tmp_path):
    _items(spark, 4000).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> dict[str, int]:
        files = blocks.getAllFiles().iterator()
        found = []
        while files.hasNext():
            found.append(files.next())
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}

    before, own, setting = shuffled(), Fixtures(spark, str(tmp_path)), spark.conf.get(inventory.DROP_SHUFFLES)
    live, today = own.live, own.today
    assert sum(size for name, size in shuffled().items() if name not in before) < 20_000
    assert spark.conf.get(inventory.DROP_SHUFFLES) == setting
    days = lambda: {r.dt for r in own.held(TODAY).select("dt").distinct().collect()}
    assert days() == {TODAY}
    n = live.count(), today.count()
    # added to the table; views of today are as before, and a bucket stays one sorted file
    assert own.inventory.where(F.col("dt") == TODAY).exceptAll(today).isEmpty() and own.inventory.where(F.col("dt") < TODAY).count() > 3000
    assert days() == {YESTERDAY, TODAY} and (live.count(), today.count()) == n
    assert own.listed.exceptAll(own.inventory).isEmpty() and own.inventory.exceptAll(own.listed).isEmpty()
    of = F.regexp_extract(F.input_file_name(), "_([0-9]+)\\.c", 1).alias("of")
    files = own.held(TODAY).select("dt", "side", of, F.input_file_name().alias("file")).distinct()
    assert {r["count"] for r in files.groupBy("dt", "side", "of").count().collect()} == {1}


def test_queries_that_match_keys_shuffle_objects_once_and_leave_nothing(spark, tmp_path, plan_of):
    from __spark_entry__ import queries

    _items(spark, 20000).write.parquet(f"{tmp_path}/lineitem.parquet")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> int:
        files, size = blocks.getAllFiles().iterator(), 0
        while files.hasNext():
            file = files.next()
            size += file.length() if file.getName().startswith("shuffle_") else 0
        return size

    stored, left = _bytes(work_root(spark)), shuffled()
    for name in ("divergence_counts", "head_check", "apply_sync_versions", "batch_fee", "diff_predicate_smart", "integrity_diffs", "sync_summary"):
        df = queries()[name](spark, str(tmp_path))
        dealt = [line for line in plan_of(df).splitlines() if "REPARTITION_BY_NUM" in line]
        # files of many tasks are spread no further, so this is the shuffle by key alone
        assert len([line for line in dealt if "ReusedExchange" not in line]) == 1, name
    assert _bytes(work_root(spark)) - stored < 20_000
    for _ in range(50):
        if shuffled() - left < 20_000:
            break
        time.sleep(0.2)
    assert shuffled() - left < 20_000
    own = Fixtures(spark, str(tmp_path))
    for dealt, listed in (
        (own.dealt_inventory, own.listed), (own.dealt_today, own.listed.where(F.col("dt") == TODAY)), (own.dealt_live, own.listed_live),
        (own.dealt_checksums, own.listed_checksums), (own.dealt_sources, own.listed_sources),
    ):
        assert dealt.exceptAll(listed).isEmpty() and listed.exceptAll(dealt).isEmpty()


def test_a_file_of_many_row_groups_is_not_shuffled(spark, tmp_path, plan_of):
    cores = spark.sparkContext.defaultParallelism
    items = _items(spark, 4000).withColumn("l_comment", F.sha2(F.col("l_orderkey").cast("string"), 512))
    items.coalesce(1).write.option("parquet.block.size", 1 << 14).option("parquet.block.size.row.check.min", 10).parquet(f"{tmp_path}/many/lineitem.parquet")
    items.coalesce(1).write.parquet(f"{tmp_path}/one/lineitem.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 14)
    try:
        plans = [plan_of(Fixtures(spark, f"{tmp_path}/{form}").spread("lineitem", ["l_orderkey"], ["l_orderkey"])) for form in ("many", "one")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert cores > 2 and ["Exchange" in plan for plan in plans] == [False, True]


def test_inventory_is_written_by_the_tasks_that_read_it(spark, tmp_path):
    rows = spark.range(0, 300, 1, 3).selectExpr(
        "'b' AS bucket", "'main' AS label", "concat('k', id) AS key", "id AS size", "'2024-01-30-01-00' AS dt", "'a' AS source_alias", "'source' AS side",
    )
    inventory.write_inventory(rows, str(tmp_path / "inv"), rows_per_file=60)
    files = list((tmp_path / "inv").rglob("*.parquet"))
    # no shuffle dealt the one snapshot to one task, and no file is longer than asked for
    assert len(files) == 6 and inventory.read_inventory(spark, str(tmp_path / "inv")).count() == 300
