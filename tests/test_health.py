import pytest
from pyspark.sql import functions as F

from stowcheck.operators import health

FIELDS = (
    "source_alias string, inventory_enabled boolean, inventory_age_hours double, missing long, still_missing long, "
    "orphans long, orphans_before long, delta long, restore_result string, pitr_enabled boolean, "
    "backup_age_hours double, failure_pct double, exports_failed long"
)
HEALTHY = dict(
    source_alias="a", inventory_enabled=True, inventory_age_hours=3.0, missing=0, still_missing=0, orphans=0, orphans_before=0,
    delta=5, restore_result="passed", pitr_enabled=True, backup_age_hours=2.0, failure_pct=0.0, exports_failed=0,
)
# changes -> three colours, four colours
CASES = [
    ({}, "green", "amber"),
    ({"delta": 0}, "green", "blue"),
    ({"delta": None}, "green", "green"),
    ({"restore_result": "failed"}, "red", "red"),
    ({"restore_result": None, "delta": 0}, "green", "blue"),
    ({"restore_result": "skipped", "delta": 0}, "green", "green"),
    ({"pitr_enabled": False}, "red", "red"),
    ({"pitr_enabled": None, "delta": 0}, "green", "blue"),
    ({"inventory_age_hours": None}, "red", "red"),
    ({"inventory_age_hours": 30.0, "delta": 0}, "green", "blue"),
    ({"inventory_age_hours": 30.1, "delta": 0}, "yellow", "amber"),
    ({"missing": 3, "still_missing": 1}, "red", "red"),
    ({"missing": 3, "still_missing": 0, "delta": 0}, "red", "amber"),
    ({"orphans": 4, "delta": 0}, "green", "amber"),
    ({"orphans_before": 4, "delta": 0}, "green", "green"),
    ({"backup_age_hours": 36.1, "delta": 0}, "red", "blue"),
    ({"backup_age_hours": 12.1, "delta": 0}, "yellow", "blue"),
    ({"backup_age_hours": None, "delta": 0}, "green", "blue"),
    ({"failure_pct": 0.1, "delta": 0}, "green", "blue"),
    ({"failure_pct": 0.11, "delta": 0}, "red", "blue"),
    ({"exports_failed": 1, "delta": 0}, "red", "blue"),
    ({"inventory_enabled": False, "inventory_age_hours": None, "delta": None, "orphans": None}, "green", "blue"),
    ({"inventory_enabled": False, "missing": 9}, "green", "blue"),
]


def test_classification(spark):
    rows = [tuple({**HEALTHY, **change, "source_alias": str(i)}.values()) for i, (change, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, FIELDS)
    got = {
        r.source_alias: (r.three, r.four)
        for r in df.select("source_alias", health.classify_source().alias("three"), health.classify_four_color().alias("four")).collect()
    }
    assert [got[str(i)] for i in range(len(CASES))] == [case[1:] for case in CASES]


@pytest.mark.parametrize("colours, overall, healthy", [(["green", "red", "yellow"], "red", 1), (["green", "yellow"], "yellow", 1), (["green"], "green", 1), ([], "green", 0)])
def test_overall_and_headline(spark, colours, overall, healthy):
    df = spark.createDataFrame([(c,) for c in colours], "overall string")
    rolled = health.report_overall(df)
    assert rolled.collect()[0].asDict() == {"overall": overall, "healthy": healthy, "total": len(colours)}
    line = health.report_headline(rolled, F.lit("2026-06-10").cast("date")).collect()[0].headline
    assert line == f"backup health 2026-06-10 — {overall.upper()} ({healthy}/{len(colours)})"


NOTE_FIELDS = (
    "inventory_enabled boolean, inventory_age_hours double, missing long, tag string, backup_age_hours double, delta long, delta_pct double, "
    "orphans long, exports_completed long, exports_in_progress long, exports_failed long, exports_no_recent long, exports_errored long, "
    "batch_warnings array<string>, batch_infos array<string>"
)


def test_notes(spark):
    rows = [
        (True, None, 12345, " (tag)", None, 1500, 2.25, 7, 1, 0, 2, 1, 1, ["w", None], [None, "i"]),
        (True, 5.0, 0, None, 48.25, -3, None, 0, 0, 0, 0, 4, 0, None, None),
        (False, None, None, None, 3.0, None, None, None, 0, 1, 0, 1, 0, None, None),
        (True, 5.0, 0, None, 20.0, 0, 0.0, 0, 0, 0, 0, 0, 0, None, None),
    ]
    df = spark.createDataFrame(rows, NOTE_FIELDS)
    warnings, infos = health.notes()
    got = [(r[0], r[1]) for r in df.select(warnings, infos).collect()]
    assert got[0] == (
        ["no inventory data available", "backup is missing 12,345 source keys (tag)",
         "no recent backup run on record (never run? config drift?)", "w",
         "DynamoDB exports: 2 table(s) FAILED on last run", "DynamoDB exports: status check errored on 1 table(s)"],
        ["source grew by 1,500 objects vs yesterday (+2.2%)", "backup has 7 orphans (source-side deletions retained)", "i",
         "DynamoDB exports: 1 table(s) with no recent export"],
    )
    assert got[1] == (["last backup 48.2h ago (> 36h red threshold)"], ["source dropped by 3 objects vs yesterday"])
    assert got[2] == ([], ["last backup 3.0h ago", "DynamoDB exports: 1 table(s) with no recent export"])
    assert got[3] == (["last backup 20.0h ago (> 12h yellow threshold)"], [])


def test_batch_notes(spark):
    rows = [("a", "b1", 371, 340, 340 / 371), ("a", "b2", 1000, 5, 0.005), ("a", "b3", 10, 0, 0.0), ("a", "b4", 0, 0, 0.0)]
    df = spark.createDataFrame(rows, "source_alias string, bucket string, total_tasks long, tasks_failed long, failure_pct double")
    row = health.batch_notes(df).collect()[0]
    assert [w for w in row.batch_warnings if w] == ["S3 batch b1: 340/371 failed (92%, > 10% red threshold)"]
    assert [i for i in row.batch_infos if i] == ["S3 batch b2: 5/1,000 failed (0.5%)"]
