import pytest
from pyspark.sql import functions as F

from stowcheck.functions.times import reject_reason
from stowcheck.sources import publish, sinks


def snapshot(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, size bigint")


def seen(spark, root):
    return sorted(tuple(r) for r in publish.read_published(spark, root).select("dt", "key", "size").collect())


def test_readers_see_whole_runs_only(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, root)
    assert publish.publish_snapshot(snapshot(spark, ("a", 1), ("b", None)), root, "2024-01-30-01-00", "r1")
    old = [("2024-01-30-01-00", "a", 1), ("2024-01-30-01-00", "b", None)]
    assert sorted(seen(spark, root), key=str) == sorted(old, key=str)
    # a run that fails in its tasks
    broken = snapshot(spark, ("a", 2), ("c", 3)).withColumn("size", F.when(F.col("key") == "c", F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("size")))
    with pytest.raises(Exception, match="lost"):
        publish.publish_snapshot(broken, root, "2024-01-30-01-00", "r2")
    # a run that fails between its rows and the switch
    publish.stage_snapshot(snapshot(spark, ("a", 2)), root, "2024-01-30-01-00", "r2")
    assert sorted(seen(spark, root), key=str) == sorted(old, key=str)
    # repeated as a whole
    whole = snapshot(spark, ("a", 2), ("c", 3))
    assert publish.publish_snapshot(whole, root, "2024-01-30-01-00", "r2")
    new = [("2024-01-30-01-00", "a", 2), ("2024-01-30-01-00", "c", 3)]
    assert seen(spark, root) == new
    assert not publish.publish_snapshot(snapshot(spark, ("z", 9)), root, "2024-01-30-01-00", "r2")
    assert seen(spark, root) == new


def test_days_are_published_apart(spark, tmp_path):
    root = str(tmp_path)
    publish.publish_snapshot(snapshot(spark, ("a", 1)), root, "2024-01-30-01-00", "r")
    publish.publish_snapshot(snapshot(spark), root, "2024-01-31-01-00", "r")
    publish.publish_snapshot(snapshot(spark, ("a", 2)), root, "2024-01-30-01-00", "later")
    assert seen(spark, root) == [("2024-01-30-01-00", "a", 2)]
    assert publish.published_runs(spark, root).count() == 3


def test_good_and_rejected_rows_add_up(spark, tmp_path):
    cases = {
        "2024-01-30T10:00:00Z": None, "10:00 UTC": None, " 2024-01-30 10:00 NZDT ": None,
        None: "empty", "  ": "empty", "2024-02-31": "no such date or time", "25:00 UTC": "no such date or time",
        "2024-01-30 10:00 XYZ": "unknown zone", "10:00 Z": "unknown zone", "yesterday": "unknown format",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, text string")
    path = str(tmp_path / "out")
    assert sinks.write_with_rejects(df, path, reject_reason(F.col("text"))) == (3, 7)
    good = {r.text for r in sinks.read_good(df, path).collect()}
    rejected = {r.text: r.reason for r in sinks.read_rejects(df, path).collect()}
    assert good == {t for t, reason in cases.items() if reason is None}
    assert rejected == {t: reason for t, reason in cases.items() if reason}


def test_no_rows_and_no_rejects(spark, tmp_path):
    df = spark.createDataFrame([], "id int, text string")
    path = str(tmp_path / "out")
    assert sinks.write_with_rejects(df, path, reject_reason(F.col("text"))) == (0, 0)
    assert sinks.read_good(df, path).count() == sinks.read_rejects(df, path).count() == 0
