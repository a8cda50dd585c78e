"""Delivered snapshots read through their symlinks, and counts kept per snapshot."""

import datetime

import pytest
from pyspark.sql import functions as F

from stowcheck.operators import snapshots
from stowcheck.sources import counts, delivery
from stowcheck.sources.fixtures import TODAY, YESTERDAY


@pytest.fixture(scope="module")
def delivered(spark, fx, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("delivered"))
    delivery.deliver(fx.inventory, f"file://{path}")
    return path, snapshots.delivery_catalogue(delivery.list_deliveries(spark, path), fx.bucket_pairs)


def test_whole_delivery_equals_the_inventory(spark, fx, delivered):
    path, catalogue = delivered
    columns = ["dt", "source_alias", "side", "label", "bucket", "key", "is_latest", "size", "last_modified_date", "e_tag"]
    rows = delivery.read_delivered(spark, path, catalogue)
    assert rows.columns[-3:] == ["dt", "source_alias", "side"]
    kept = fx.inventory.withColumn("last_modified_date", F.col("last_modified_date").cast("timestamp"))
    assert rows.select(columns).exceptAll(kept.select(columns)).isEmpty()
    assert kept.select(columns).exceptAll(rows.select(columns)).isEmpty()


def test_filters_drop_scans_and_columns(spark, fx, delivered, plan_of):
    path, catalogue = delivered
    rows = delivery.read_delivered(spark, path, catalogue)
    assert plan_of(rows.select("key")).count("FileScan") == catalogue.count()
    one = rows.where((F.col("dt") == YESTERDAY) & (F.col("source_alias") == "bravo") & (F.col("side") == "backup") & (F.col("label") == "extra"))
    plan = plan_of(one.where("size > 5").select("key"))
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<key:string,size:bigint>" in plan and "GreaterThan(size,5)" in plan


def test_no_snapshot_and_missing_file(spark, delivered, tmp_path):
    path, catalogue = delivered
    assert delivery.read_delivered(spark, path, catalogue.where("false")).count() == 0
    folder = tmp_path / "inventory/delta/source/src-delta/src-delta/daily/hive/dt=d"
    folder.mkdir(parents=True)
    (folder / "symlink.txt").write_text(f"\n{tmp_path}/gone.parquet\n\n")
    one = catalogue.where("source_alias = 'delta' AND side = 'source'").limit(1).withColumn("dt", F.lit("d"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        delivery.read_delivered(spark, str(tmp_path), one)


def test_only_new_and_repeated_deliveries_are_counted(spark, fx, tmp_path):
    path = str(tmp_path / "counts")
    assert counts.read_counts(spark, path).count() == 0
    old = fx.catalogue.where(F.col("dt") == YESTERDAY)
    n_old, n_all = old.count(), fx.catalogue.count()
    assert counts.record_counts(fx.inventory, old, path) == n_old
    assert counts.record_counts(fx.inventory, fx.catalogue, path) == n_all - n_old
    assert counts.record_counts(fx.inventory, fx.catalogue, path) == 0
    got = {tuple(r)[:4]: r.objects for r in counts.read_counts(spark, path).collect()}
    want = {tuple(r)[:4]: r.objects for r in snapshots.bucket_counts(fx.inventory).collect()}
    assert got == want
    # delivered again with fewer rows, and one delivered without any
    again = fx.catalogue.withColumn(
        "delivered_at", F.when((F.col("dt") == TODAY) & (F.col("label") == "extra"), F.lit(datetime.datetime(2024, 2, 1))).otherwise(F.col("delivered_at"))
    )
    empty = spark.createDataFrame([("bravo", "extra", "source", "x", "2024-02-02", datetime.datetime(2024, 2, 2))], again.schema)
    smaller = fx.inventory.where("NOT (label = 'extra' AND key LIKE 'models/%')")
    assert counts.record_counts(smaller, again.union(empty), path) == 3
    got = {tuple(r)[:4]: r.objects for r in counts.read_counts(spark, path).collect()}
    want |= {tuple(r)[:4]: r.objects for r in snapshots.bucket_counts(smaller.where(F.col("dt") == TODAY)).where("label = 'extra'").collect()}
    assert got == want | {("bravo", "extra", "source", "2024-02-02"): 0}


def test_counting_reads_only_new_partitions(fx, plan_of):
    todo = fx.catalogue.where((F.col("dt") == YESTERDAY) & (F.col("label") == "old"))
    assert "dynamicpruning" in plan_of(snapshots.at_delivered(fx.inventory, todo).select("key"))
