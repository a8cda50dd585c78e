from datetime import datetime
from urllib.parse import quote

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowcheck.functions import keys, objects, text, times


def apply(spark, values, function, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.select(function(F.col("v")), "i").orderBy("i").collect()]


KEYS = [
    "plain/name-1.parquet", "two  spaces/and\ttab", 'say "x"/\'y\'', "a#b?c&d=e", "100%/50%25", "x,y;z:@!$()[]{}",
    "é~*/x", "日本/🎉",
    "".join(map(chr, range(1, 127))),
]


def test_encode_key_matches_the_standard_library(spark):
    assert apply(spark, KEYS, keys.encode_key) == [quote(k, safe="/") for k in KEYS]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), min_size=1), min_size=1, max_size=200))
def test_encode_key_property(spark, values):
    assert apply(spark, values, keys.encode_key) == [quote(v, safe="/") for v in values]


def test_is_operational_is_a_prefix_test(spark):
    values = ["_state/a", "_manifests/b", "_batch-reports/c", "_events/d", "xstate/a", "_stateful", "a/_state/", "_"]
    assert apply(spark, values, keys.is_operational) == [True] * 4 + [False] * 4


def test_sanitize_identifier(spark):
    values = ["inv_a-b.C", "__x__", "---", "é"]
    assert apply(spark, values, keys.sanitize_identifier) == ["inv_a_b_c", "x", "x", "x"]


def test_parse_uri(spark):
    values = ["s3://b/k/é", "s3://b/", "s3:///k", "http://b/k", "s3://b", "s3://b/a\nb"]
    assert apply(spark, values, keys.uri_is_valid) == [True, False, False, False, False, True]
    assert apply(spark, values, keys.uri_bucket) == ["b", None, None, None, None, "b"]
    assert apply(spark, values, keys.uri_key)[0] == "k/é"
    assert apply(spark, values, keys.uri_key)[5] == "a\nb"


def test_symlink_path(spark):
    path = "inventory/a/source/b/b/id/hive/dt=2026-04-21-01-00/symlink.txt"
    assert apply(spark, [path, "x/symlink.txt"], keys.symlink_dt) == ["2026-04-21-01-00", None]
    assert apply(spark, [path], keys.symlink_root) == ["inventory/a/source/b/b/id/hive/"]


def test_arn_and_names(spark):
    arn = "arn:aws:dynamodb:ap-southeast-2:210987654321:table/Things"
    assert apply(spark, [arn], keys.arn_table) == ["Things"]
    assert apply(spark, [arn], keys.arn_account) == ["210987654321"]
    assert apply(spark, ["arn:aws:s3:::data"], keys.arn_bucket) == ["data"]
    assert apply(spark, ["short", "x" * 60], keys.restore_bucket_name) == ["short-restore", "x" * 55 + "-restore"]
    assert len(apply(spark, ["t/" + "y" * 300], keys.restore_table_name)[0]) == 255


def test_current_version_counts_null_flags(spark):
    rows = [(None, None), (True, False), (False, False), (True, True), (None, True)]
    df = spark.createDataFrame(rows, "l boolean, d boolean")
    got = [r[0] for r in df.select(objects.is_current(F.col("l"), F.col("d"))).collect()]
    assert got == [True, True, False, False, False]


CHANGES = [
    # missing, sizes, tags -> smart, strict
    (True, 1, None, "a", None, True, True),
    (False, 1, 1, "a", "a", False, False),
    (False, 1, 2, "a", "a", True, True),
    (False, 1, 1, "a", "b", True, True),
    (False, 1, 1, "a-2", "b", False, True),
    (False, 1, 1, "a", "b-3", False, True),
    (False, None, 1, "a", "a", False, True),
    (False, 1, 1, None, "b", False, True),
    (False, 1, 1, None, None, False, False),
]


def test_change_rules(spark):
    df = spark.createDataFrame(
        [r[:5] for r in CHANGES], "m boolean, s long, d long, st string, dt string"
    )
    columns = [F.col(c) for c in ("m", "s", "d", "st", "dt")]
    got = df.select(
        objects.needs_copy_smart(*columns),
        objects.needs_copy_strict(*columns),
        objects.needs_copy_strict(*columns, full_sync=True),
    ).collect()
    assert [tuple(r)[:2] for r in got] == [r[5:] for r in CHANGES]
    assert all(r[2] for r in got)


def test_pick_checksum_priority_and_empty(spark):
    df = spark.createDataFrame(
        [("", "c", "s"), ("n", "c", "s"), (None, None, "s"), (None, "", None)],
        "crc64nvme string, crc32 string, sha256 string",
    )
    got = [r[0] for r in df.select(objects.pick_checksum(df.columns)).collect()]
    assert [tuple(g) if g else None for g in got] == [
        ("ChecksumCRC32", "c"), ("ChecksumCRC64NVME", "n"), ("ChecksumSHA256", "s"), None,
    ]


def test_etags(spark):
    assert apply(spark, ['"a"', "a", '"a-2"'], objects.normalize_etag) == ["a", "a", "a-2"]
    assert apply(spark, ['"a"', "a"], objects.quote_etag) == ['"a"', '"a"']
    assert apply(spark, ["a-2", "a"], objects.is_multipart) == [True, False]


TIMES = {
    "2026-03-25T07:50:00+13:00": datetime(2026, 3, 24, 18, 50),
    "2026-03-25T07:50:00+1300": datetime(2026, 3, 24, 18, 50),
    "2026-03-25T07:50:00+13": datetime(2026, 3, 24, 18, 50),
    "2026-03-25T09:00:00Z": datetime(2026, 3, 25, 9),
    "2026-03-25T09:00:00": datetime(2026, 3, 25, 9),
    "2026-03-25 09:00:00.123456": datetime(2026, 3, 25, 9, 0, 0, 123456),
    "2026-03-25 09:00": datetime(2026, 3, 25, 9),
    "2026-03-25": datetime(2026, 3, 25),
    "2026-03-25 07:50 NZDT": datetime(2026, 3, 24, 18, 50),
    "2026-06-01 02:00 NZST": datetime(2026, 5, 31, 14),
    "2026-03-25 14:00 UTC": datetime(2026, 3, 25, 14),
    "2026-03-25 12:00 AEST": datetime(2026, 3, 25, 2),
    "2026-03-25 12:00 AEDT": datetime(2026, 3, 25, 1),
    "07:50 NZDT": datetime(1999, 12, 31, 18, 50),
    "  2026-03-25 14:00 UTC  ": datetime(2026, 3, 25, 14),
    "not a time": None,
    "2026-03-25 07:50 CET": None,
    "2026-13-25 07:50 UTC": None,
    "": None,
}


def test_parse_event_time(spark):
    assert apply(spark, list(TIMES), times.parse_event_time) == list(TIMES.values())


@pytest.mark.parametrize("utc, local", [("2026-06-01 11:59:00", "2026-06-01"), ("2026-06-01 12:00:00", "2026-06-02"), ("2026-01-01 11:00:00", "2026-01-02")])
def test_local_report_date_follows_daylight_saving(spark, utc, local):
    got = apply(spark, [utc], lambda v: times.local_report_date(v.cast("timestamp")).cast("string"))
    assert got == [local]


def test_text(spark):
    long = "z" * 101
    assert apply(spark, ["a" * 100, long], lambda v: text.truncate_text(v, 100)) == ["a" * 100, "z" * 99 + "…"]
    messages = ["it failed because of x because  disk full ", "plain", "b" * 200]
    assert apply(spark, messages, text.failure_reason) == ["disk full", "plain", "b" * 120]
    assert apply(spark, ["restore: a → b → c", "none"], text.description_target) == ["c", ""]


def test_event_fields(spark):
    rows = [
        ("backup_run", '{"table":"t","export_arn":"x/y/exp1"}'),
        ("backup_run", '{"bucket":"b","table":"t","objects_in_manifest":7}'),
        ("restore_completed", '{"dest_table":"d"}'),
        ("pitr_reenabled", '{"table_arn":"arn/table/p"}'),
        ("test_restore", "{}"),
        ("other", "{}"),
    ]
    df = spark.createDataFrame(rows, "t string, d string")
    got = df.select(text.event_target(F.col("t"), F.col("d")), text.event_extent(F.col("d"))).collect()
    assert [r[0] for r in got] == ["t", "b", "d", "p", "?", None]
    assert [r[1] for r in got[:2]] == ["exp1", "7 objects in manifest"]
