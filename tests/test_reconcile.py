import random
from collections import Counter

from pyspark.sql import functions as F

from stowcheck.operators import maintenance, reconcile, restore, snapshots

SIDE = "source_alias string, bucket string, key string, size long, e_tag string"
INVENTORY = (
    "dt string, source_alias string, side string, key string, is_latest boolean, is_delete_marker boolean"
)


def listing(spark, rows, alias="a"):
    return labelled(spark.createDataFrame([(alias, "b", *r) for r in rows], SIDE))


def labelled(df):
    return df.withColumn("label", F.lit("main"))


def test_integrity_cascade(spark):
    source = listing(spark, [
        ("same", 1, "x"), ("gone", 1, "x"), ("rescued", 1, "x"), ("multi", 1, "x-2"),
        ("bad", 1, "x"), ("other-algo", 1, "x"), ("conflict", 1, "x-2"), ("_state/s", 1, "x"),
        ("size-only", 1, "x"), ("quoted", 1, '"x"'),
    ])
    backup = listing(spark, [
        ("same", 1, "x"), ("rescued", 1, "y"), ("multi", 1, "y"), ("bad", 1, "y"),
        ("other-algo", 1, "y"), ("conflict", 1, "y"), ("size-only", 2, "x"), ("extra", 1, "e"), ("quoted", 1, "x"),
    ])
    checksums = spark.createDataFrame(
        [
            ("source", "a", "rescued", "c", None), ("backup", "a", "rescued", "c", "s"),
            ("source", "a", "other-algo", "c", None), ("backup", "a", "other-algo", None, "c"),
            ("source", "a", "conflict", "c", None), ("backup", "a", "conflict", "d", None),
        ],
        "side string, source_alias string, key string, crc64nvme string, sha256 string",
    )
    status = reconcile.integrity_status(source, backup, labelled(checksums))
    got = {r.key: (r.issue, r.checksum_conflict) for r in status.collect()}
    assert got == {
        "gone": ("missing_in_backup", False),
        "rescued": ("verified", False),
        "multi": ("verified", False),
        "bad": ("etag_mismatch", False),
        "other-algo": ("etag_mismatch", False),
        "conflict": ("verified", True),
    }
    summary = reconcile.integrity_summary(source, backup, status).collect()[0]
    assert (summary.source_object_count, summary.backup_object_count) == (9, 9)
    assert (summary.missing_count, summary.mismatch_count, summary.checksum_verified) == (1, 2, 3)
    assert not summary.clean


def test_manifest_without_backup_and_full_sync(spark):
    source = listing(spark, [("a b", 1, "x"), ("c", 2, "y")])
    same = source
    empty = source.where("false")
    assert {r.key for r in reconcile.inventory_diff(source, empty).collect()} == {"a%20b", "c"}
    assert reconcile.inventory_diff(source, same).count() == 0
    assert reconcile.inventory_diff(source, same, full_sync=True).count() == 2
    forced = reconcile.listing_diff(source, same, full_sync=True).collect()
    assert {r.reason for r in forced} == {"forced"}
    summary = reconcile.sync_summary(source, same, full_sync=True).collect()[0]
    assert (summary.objects_copied, summary.objects_skipped, summary.bytes_transferred) == (2, 0, 3)


def inventory(spark, rows):
    return labelled(spark.createDataFrame(rows, INVENTORY))


def test_divergence_counts_empty_and_absent_snapshots(spark):
    rows = [("d1", "full", "source", f"k{i}", None, None) for i in range(5)]
    rows += [("d1", "full", "backup", f"k{i}", True, False) for i in range(3, 8)]
    rows += [("d1", "full", "backup", "k9", False, False), ("d1", "full", "backup", "_state/x", True, False)]
    rows += [("d1", "first", "source", "k", None, None), ("d1", "first", "backup", "_state/x", True, False)]
    rows += [("d1", "alone", "source", "k", None, None)]
    inv = inventory(spark, rows)
    sides = reconcile.key_sides(inv, "d1")
    got = {
        r.source_alias: (r.source_minus_backup, r.backup_minus_source, r.available)
        for r in reconcile.divergence_counts(sides, snapshots.latest_partitions(inv)).collect()
    }
    # a backup that only holds reserved keys is delivered and empty; none at all is unavailable
    assert got == {"full": (3, 3, True), "first": (1, 0, True), "alone": (None, None, False)}


def test_divergence_equals_brute_force_with_repeated_keys(spark):
    rng = random.Random(3)
    rows = [
        ("d", rng.choice("ab"), rng.choice(["source", "backup"]), f"k{rng.randrange(40)}", True, False)
        for _ in range(400)
    ]
    got = {
        r.source_alias: (r.source_minus_backup, r.backup_minus_source)
        for r in reconcile.divergence_counts(
            reconcile.key_sides(inventory(spark, rows), "d"),
            spark.createDataFrame([(a, s, "d") for a in "ab" for s in ("source", "backup")], "source_alias string, side string, dt string").withColumn("label", F.lit("main")),
        ).collect()
    }
    for alias in "ab":
        held = {s: [r[3] for r in rows if r[1] == alias and r[2] == s] for s in ("source", "backup")}
        missing = sum(k not in set(held["backup"]) for k in held["source"])
        orphans = sum(k not in set(held["source"]) for k in held["backup"])
        assert got[alias] == (missing, orphans)


def test_count_delta_edges(spark):
    rows = [("d1", "one", "source", "k", None, None)]
    rows += [("d1", "zero", "source", "k", True, True), ("d2", "zero", "source", "k", True, False)]
    rows += [(d, "two", "source", f"k{i}", None, None) for d, n in (("d1", 4), ("d2", 3)) for i in range(n)]
    got = {r.source_alias: r for r in snapshots.count_delta(snapshots.bucket_counts(inventory(spark, rows))).collect()}
    assert (got["one"].today_count, got["one"].delta, got["one"].available) == (1, None, False)
    assert (got["zero"].yesterday_count, got["zero"].delta, got["zero"].delta_pct) == (0, 1, None)
    assert (got["two"].delta, got["two"].delta_pct) == (-1, -25.0)


def test_freshness_ignores_placeholders_and_needs_both_sides(spark):
    rows = [
        ("a", "source", 10, "2024-01-01 00:00:00"), ("a", "source", 0, "2024-01-05 00:00:00"),
        ("a", "backup", 10, "2024-01-02 00:00:00"), ("b", "source", 10, "2024-01-02 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "source_alias string, side string, size long, t string").withColumn(
        "last_modified", F.col("t").cast("timestamp")
    )
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    got = {r.source_alias: (r.age_hours, r.stale) for r in snapshots.inventory_freshness(df, now).collect()}
    assert got == {"a": (36.0, True), "b": (None, False)}


def test_restore_diff_skips_equal_and_reserved(spark):
    backup = listing(spark, [("p/same", 1, "x"), ("p/diff", 2, "x"), ("p/new", 4, "x"), ("_events/e", 8, "x"), ("q/new", 16, "x")])
    target = listing(spark, [("p/same", 1, "x"), ("p/diff", 2, "y"), ("other", 1, "z")])
    assert {r.key for r in restore.restore_diff(backup, target).collect()} == {"p/diff", "p/new", "q/new"}
    row = restore.restore_diff_summary(backup, target, prefix="p/").collect()[0]
    assert (row.objects_copied, row.objects_skipped, row.bytes_transferred) == (2, 1, 6)


def test_random_sample(spark, fx):
    from stowcheck.sources.fixtures import TODAY

    backup = snapshots.backup_side(fx.inventory, TODAY)
    sample = restore.sample_restore_random(backup, 25, seed=1).collect()
    key = lambda r: (r.source_alias, r.label, r.key)
    eligible = {key(r) for r in restore.restorable(backup).collect()}
    drawn = {key(r) for r in sample}
    assert len(sample) == len(drawn) and drawn <= eligible
    # every bucket of every source gets its own draw
    held = Counter(k[:2] for k in eligible)
    assert Counter(k[:2] for k in drawn) == {b: min(n, 25) for b, n in held.items()}
    assert len(held) == 5
    few = restore.restorable(backup).where("label = 'main' AND source_alias = 'alpha'").limit(4).cache()
    assert restore.sample_restore_random(few.withColumn("storage_class", F.lit(None).cast("string")), 25).count() == 4


def test_verify_and_rollup(spark):
    sample = listing(spark, [("ck", 1, "x"), ("ckbad", 1, "x"), ("tag", 1, "x"), ("tagbad", 1, "x"), ("lost", 1, "x")])
    restored = listing(spark, [("ck", 1, "other"), ("ckbad", 1, "x"), ("tag", 1, "x"), ("tagbad", 1, "y")])
    checksums = spark.createDataFrame(
        [("backup", "a", "ck", "1"), ("source", "a", "ck", "1"), ("backup", "a", "ckbad", "1"), ("source", "a", "ckbad", "2"),
         ("backup", "a", "tag", "1")],
        "side string, source_alias string, key string, crc64nvme string",
    )
    verified = restore.restore_verify(sample, restored, labelled(checksums))
    got = {r.key: (r.outcome, r.detail) for r in verified.collect()}
    assert got["ck"] == ("verified", None) and got["tag"] == ("verified", None)
    assert got["ckbad"] == ("mismatch", "ChecksumCRC64NVME mismatch: 1 != 2")
    assert got["tagbad"] == ("mismatch", "ETag mismatch: y != x")
    assert got["lost"][0] == "copy_error"
    results = restore.bucket_results(verified, bucket_pairs(spark, ("a", "main"), ("idle", "main")))
    got = {r.source_alias: r for r in results.collect()}
    assert {a: r.result for a, r in got.items()} == {"a": "failed", "idle": "skipped"}
    assert [e.key for e in got["a"].errors] == ["lost"] and [e.key for e in got["a"].mismatches] == ["ckbad", "tagbad"]
    assert restore.restore_test_overall(results).collect()[0].overall == "failed"
    skipped = results.where("source_alias = 'idle'")
    assert restore.restore_test_overall(skipped).collect()[0].overall == "skipped"
    assert restore.restore_test_overall(skipped.where("false")).collect()[0].overall == "skipped"


def test_head_check_tags(spark):
    sample = spark.createDataFrame([(a, f"k{i}") for a in "xyz" for i in range(2)], "source_alias string, key string")
    live = spark.createDataFrame([("y", "k0"), ("y", "k1"), ("z", "k0"), ("q", "k0")], "source_alias string, key string")
    for bounded in (True, False):
        tags = {r.source_alias: r.tag for r in restore.head_check(labelled(sample), labelled(live), bounded).collect()}
        assert tags == {
            "x": " (still missing live, sampled 2)",
            "y": " (auto-healed since snapshot, sampled 2)",
            "z": " (1 still missing, 1 auto-healed, sampled 2)",
        }


def test_restore_targets_by_weekday(spark):
    registry = spark.createDataFrame([("a",), ("b",)], "source_alias string")
    due = lambda day: {r[0] for r in restore.restore_test_targets(registry, day, "a", {0: "b", 2: "gone"}).collect()}
    assert (due(0), due(1), due(2)) == ({"a", "b"}, {"a"}, {"a"})


def two_buckets(spark, rows):
    """Rows (label, key, size, e_tag) of one source."""
    df = spark.createDataFrame([("a", f"b-{r[0]}", *r) for r in rows], "source_alias string, bucket string, label string, key string, size long, e_tag string")
    return df.withColumn("last_modified_date", F.lit("2024-01-01").cast("timestamp"))


def test_one_key_in_two_buckets(spark):
    source = two_buckets(spark, [("one", "k", 1, "x"), ("two", "k", 2, "y"), ("two", "both", 3, "z"), ("one", "both", 4, "w")])
    backup = two_buckets(spark, [("one", "k", 1, "x"), ("one", "both", 4, "w"), ("two", "both", 3, "z"), ("one", "orphan", 5, "o")])
    assert {(r.label, r.key) for r in reconcile.missing_keys(source, backup).collect()} == {("two", "k")}
    assert {(r.label, r.key) for r in reconcile.orphan_keys(source, backup).collect()} == {("one", "orphan")}
    # equal copies under one key don't differ from each other's
    assert [(r.bucket, r.key) for r in reconcile.inventory_diff(source, backup).collect()] == [("b-two", "k")]
    assert [(r.bucket, r.reason) for r in reconcile.listing_diff(source, backup).collect()] == [("b-two", "missing")]
    assert {(r.label, r.key) for r in restore.restore_diff(backup, source).collect()} == {("one", "orphan")}
    row = reconcile.sync_summary(source, backup).collect()[0]
    assert (row.objects_copied, row.objects_skipped, row.bytes_transferred) == (1, 3, 2)
    registry = spark.createDataFrame([("a", "one", "bk-1"), ("a", "two", "bk-2")], "source_alias string, label string, backup_bucket string")
    synced = maintenance.apply_sync(source, backup, registry, F.lit("2024-01-02").cast("timestamp"))
    got = {(r.label, r.key): (r.bucket, r.copied) for r in synced.collect()}
    assert got == {
        ("two", "k"): ("bk-2", True), ("one", "k"): ("b-one", False), ("one", "both"): ("b-one", False),
        ("two", "both"): ("b-two", False), ("one", "orphan"): ("b-one", False),
    }


def test_labels_come_from_the_registry(spark):
    registry = spark.createDataFrame([("a", "one", "s1", "k1"), ("a", "two", "s2", "k2")], "source_alias string, label string, source_bucket string, backup_bucket string")
    rows = spark.createDataFrame([("a", b, "k") for b in ("s1", "s2", "k1", "k2", "other")], "source_alias string, bucket string, key string")
    assert {(r.bucket, r.label) for r in reconcile.with_label(rows, registry).collect()} == {("s1", "one"), ("s2", "two"), ("k1", "one"), ("k2", "two")}


def test_each_side_is_compared_at_its_own_newest_snapshot(spark):
    rows = [("d2", "a", "source", k, True, False) for k in ("k1", "k2")] + [("d1", "a", "source", "old", True, False)]
    # the backup is a day late; the snapshot after today isn't looked at
    rows += [("d1", "a", "backup", k, True, False) for k in ("k1", "gone")] + [("d3", "a", "source", "future", True, False)]
    rows += [("d2", "b", side, "k", True, False) for side in ("source", "backup")]
    inv = inventory(spark, rows)
    newest = snapshots.newest_delivered(inv.select("source_alias", "label", "side", "dt").distinct(), "d2")
    counts = reconcile.divergence_counts(reconcile.newest_key_sides(inv, newest), newest)
    got = {r.source_alias: (r.source_dt, r.backup_dt, r.source_minus_backup, r.backup_minus_source) for r in counts.collect()}
    assert got == {"a": ("d2", "d1", 1, 1), "b": ("d2", "d2", 0, 0)}
    sides = snapshots.newest_source(inv, newest), snapshots.newest_backup(inv, newest)
    assert [r.key for r in reconcile.missing_keys(*sides).collect()] == ["k2"]
    assert [r.key for r in reconcile.orphan_keys(*sides).collect()] == ["gone"]


def bucket_pairs(spark, *buckets):
    rows = [(a, label, f"src-{a}-{label}", f"bb-{a}-{label}") for a, label in buckets]
    return spark.createDataFrame(rows, "source_alias string, label string, source_bucket string, backup_bucket string")


def delivered(*snapshots_of):
    """Paths of the snapshots (alias, label, side, dt) in a listing."""
    for alias, label, side, dt in snapshots_of:
        bucket = f"{'src' if side == 'source' else 'bb'}-{alias}-{label}"
        yield (f"inventory/{alias}/{side}/{bucket}/{bucket}/daily/hive/dt={dt}/symlink.txt",)


def test_buckets_of_a_source_delivered_on_different_days(spark):
    """``extra`` was last delivered the day before ``main``; both are compared."""
    both = ("source", "backup")
    rows = [("d2", "a", side, "main", k) for side in both for k in ("k1", "k2")]
    rows += [("d1", "a", "source", "extra", k) for k in ("e1", "e2")] + [("d1", "a", "backup", "extra", k) for k in ("e2", "e3")]
    rows += [("d1", "a", side, "main", "stale") for side in both] + [("d2", "a", "source", "half", "h")]
    inv = spark.createDataFrame(rows, "dt string, source_alias string, side string, label string, key string")
    inv = inv.withColumns({"is_latest": F.lit(True), "is_delete_marker": F.lit(False), "bucket": F.lit("b"), "size": F.lit(1), "e_tag": F.lit("t")})
    pairs = bucket_pairs(spark, ("a", "main"), ("a", "extra"), ("a", "half"), ("a", "never"), ("b", "never"))
    paths = [*delivered(*{(r[1], r[3], r[2], r[0]) for r in rows}), ("inventory/a/source/other/other/daily/hive/dt=d9/symlink.txt",), ("inventory/a/x",)]
    catalogue = snapshots.delivery_catalogue(spark.createDataFrame(paths, "key string"), pairs)
    newest = snapshots.newest_delivered(catalogue, "d3")
    sides = snapshots.newest_source(inv, newest), snapshots.newest_backup(inv, newest)
    assert {(r.label, r.key) for r in reconcile.missing_keys(*sides).collect()} == {("extra", "e1"), ("half", "h")}
    assert {(r.label, r.key) for r in reconcile.orphan_keys(*sides).collect()} == {("extra", "e3")}
    assert {r.key for r in reconcile.inventory_diff(*sides).collect()} == {"e1", "h"}
    counts = reconcile.divergence_counts(reconcile.newest_key_sides(inv, newest), newest)
    got = {r.label: (r.source_dt, r.backup_dt, r.source_minus_backup, r.backup_minus_source, r.available) for r in counts.collect()}
    assert got == {"main": ("d2", "d2", 0, 0, True), "extra": ("d1", "d1", 1, 1, True), "half": ("d2", None, None, None, False)}
    rolled = {r.source_alias: tuple(r)[1:] for r in reconcile.source_divergence(counts, pairs).collect()}
    assert rolled == {"a": (1, 1, 2), "b": (None, None, 1)}
    deltas = snapshots.count_delta(snapshots.bucket_counts(inv))
    assert {r.label: (r.today_dt, r.today_count, r.delta) for r in deltas.collect()} == {"main": ("d2", 2, 1), "extra": ("d1", 2, None), "half": ("d2", 1, None)}
    assert [tuple(r) for r in snapshots.source_delta(deltas).collect()] == [("a", 1, 100.0)]


def test_newest_snapshots_are_chosen_from_paths_alone(fx, plan_of):
    newest = snapshots.newest_delivered(fx.catalogue, "2024-01-30-01-00")
    assert {(r.label, r.side): r.dt for r in newest.where("label in ('old', 'late')").collect()} == {
        ("old", "source"): "2024-01-29-01-00", ("old", "backup"): "2024-01-29-01-00",
        ("late", "source"): "2024-01-30-01-00", ("late", "backup"): "2024-01-29-01-00",
    }
    plan = plan_of(newest)
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<key:string>" in plan
    # and prune the inventory's partitions at run time
    assert "dynamicpruning" in plan_of(snapshots.newest_source(fx.inventory, newest).select("key"))


def test_one_failed_bucket_makes_its_source_fail(spark):
    verified = spark.createDataFrame(
        [("a", "one", "k1", "verified", None), ("a", "two", "k2", "copy_error", "lost"), ("a", "two", "k3", "mismatch", "differs")],
        "source_alias string, label string, key string, outcome string, detail string",
    )
    results = restore.bucket_results(verified, bucket_pairs(spark, ("a", "one"), ("a", "two"), ("a", "idle")))
    got = {r.label: (r.backup_bucket, r.result, [e.key for e in r.errors or []], [e.key for e in r.mismatches or []]) for r in results.collect()}
    assert got == {
        "one": ("bb-a-one", "passed", [], []), "two": ("bb-a-two", "failed", ["k2"], ["k3"]), "idle": ("bb-a-idle", "skipped", [], []),
    }
    assert [(r.source_alias, r.overall, r.buckets) for r in restore.restore_test_overall(results, "source_alias").collect()] == [("a", "failed", 3)]
