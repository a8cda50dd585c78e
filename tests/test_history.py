import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stowcheck.operators import history, toolkit

SCHEMA = "key string, version_id long, last_modified timestamp, e_tag string, size long, is_delete_marker boolean"


def hot_history(spark):
    """One key holds half of all versions; many share a timestamp."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        key = "hot" if i % 2 else f"k{rng.randrange(30)}"
        at = datetime(2024, 1, 1) + timedelta(days=rng.randrange(200))
        rows.append((key, i, at, f"t{rng.randrange(3)}", i, rng.random() < 0.1))
    return rows, spark.createDataFrame(rows, SCHEMA)


def ordered(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups[row[0]].append(row)
    return groups


def test_neighbours_across_buckets_equal_brute_force(spark):
    rows, df = hot_history(spark)
    expected_kind, expected_next = {}, {}
    for group in ordered(rows).values():
        for before, row in zip([None, *group], group):
            kind = "first" if before is None else "recopy" if before[3] == row[3] else "mutation"
            expected_kind[row[1]] = kind
        for row, after in zip(group, [*group[1:], None]):
            expected_next[row[1]] = after and after[2]
    assert {r.version_id: r.kind for r in history.version_changes(df).collect()} == expected_kind
    assert {r.version_id: r.superseded_at for r in history.with_superseded_at(df).collect()} == expected_next


def test_run_match_equals_brute_force(spark):
    rng = random.Random(6)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 60))
    versions = [("a" if i % 3 else "b", f"k{i}", i, at()) for i in range(200)]
    runs = [(rng.choice("ab"), i, at()) for i in range(40)]
    versions.append(("c", "no-runs", 999, at()))
    versions.append(("a", "before-all", 1000, datetime(2023, 1, 1)))
    # a first backup: a source written in one day
    versions += [("b", f"first{i}", 2000 + i, datetime(2024, 2, 1, i % 24, i % 60)) for i in range(300)]
    got = history.mutation_run_match(
        spark.createDataFrame(versions, "source_alias string, key string, version_id long, last_modified timestamp"),
        spark.createDataFrame(runs, "source_alias string, run_id long, started_at timestamp"),
    ).collect()
    assert len(got) == len(versions)
    for row in got:
        started = [(s, i) for a, i, s in runs if a == row.source_alias and s <= row.last_modified]
        assert row.run_id == (max(started)[1] if started else None)


def test_retention_zero_keeps_everything(spark):
    _, df = hot_history(spark)
    at = F.lit("2030-01-01").cast("timestamp")
    assert history.noncurrent_expiry(df, at, 0).count() == 0
    # all but the newest version of every key
    assert history.noncurrent_expiry(df, at, 30).count() == 400 - df.select("key").distinct().count()


def test_restore_as_of_drops_deleted_keys(spark):
    rows, df = hot_history(spark)
    at = datetime(2024, 3, 1)
    expected = {}
    for key, group in ordered(rows).items():
        known = [r for r in group if r[2] <= at]
        if known and not known[-1][5]:
            expected[key] = known[-1][1]
    got = history.restore_as_of(df, F.lit(at))
    assert {r.key: r.version_id for r in got.collect()} == expected


def test_purge_batches_are_exact(spark):
    keys = [("big", f"k{i}") for i in range(2503)] + [("small", "x")]
    got = history.purge_batches(spark.createDataFrame(keys, "source_alias string, key string").withColumn("label", F.lit("main")), 1000).collect()
    sizes = defaultdict(set)
    for row in got:
        sizes[(row.source_alias, row.batch)].add(row.position)
    assert {k: len(v) for k, v in sizes.items()} == {
        ("big", 0): 1000, ("big", 1): 1000, ("big", 2): 503, ("small", 0): 1,
    }
    assert {r.key for r in got} == {k for _, k in keys}


def test_one_key_in_one_month_spreads_over_tasks(spark, plan_of):
    """Half of all versions are one key's, written at one time; its neighbours still equal brute force."""
    rng = random.Random(8)
    at = datetime(2024, 5, 5, 5)
    rows = [("hot", i, at + timedelta(hours=i // 900), f"t{rng.randrange(3)}", i, False) for i in range(2_000)]
    rows += [(f"k{rng.randrange(60)}", i, at + timedelta(days=rng.randrange(9)), f"t{rng.randrange(2)}", i, False) for i in range(2_000, 4_000)]
    rows.append((None, 9_001, at, None, 1, False))
    rows.append((None, 9_002, at, "t1", 1, False))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    kinds, nexts = {}, {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for before, row in zip([None, *group], group):
            previous = before and before[3]
            kinds[row[1]] = "first" if previous is None else "recopy" if previous == row[3] else "mutation"
        for row, after in zip(group, [*group[1:], None]):
            nexts[row[1]] = after and after[2]
    changes = history.version_changes(df)
    assert {r.version_id: r.kind for r in changes.collect()} == kinds
    assert {r.version_id: r.superseded_at for r in history.with_superseded_at(df).collect()} == nexts
    ranges = df.withColumn("range", toolkit.range_of(df, ["key", *history.ORDER], 4)).where("key = 'hot'").groupBy("range").count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 1_500


def test_versions_are_read_and_shuffled_once(spark, tmp_path, plan_of):
    path = str(tmp_path / "versions")
    hot_history(spark)[1].write.parquet(path)
    versions = spark.read.parquet(path)
    for df in (history.version_changes(versions), history.with_superseded_at(versions)):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1


def test_run_match_neither_sorts_nor_copies_versions(spark, tmp_path, plan_of):
    rng = random.Random(9)
    at = datetime(2024, 2, 1)
    # all versions and many runs on one day
    versions = [("a", f"k{i}", i, at + timedelta(minutes=rng.randrange(24 * 60))) for i in range(3_000)] + [("b", "k", 1, at)]
    runs = [("a", i, at + timedelta(minutes=rng.randrange(24 * 60))) for i in range(300)] + [("a", 900, datetime(2023, 12, 30)), ("a", 901, datetime(2023, 12, 30))]
    path = str(tmp_path / "v")
    spark.createDataFrame(versions, "source_alias string, key string, version_id long, last_modified timestamp").write.parquet(path)
    df = history.mutation_run_match(spark.read.parquet(path), spark.createDataFrame(runs, "source_alias string, run_id long, started_at timestamp"))
    plan = plan_of(df)
    assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan
    for row in df.collect():
        started = [(s, i) for a, i, s in runs if a == row.source_alias and s <= row.last_modified]
        assert (row.run_started_at, row.run_id) == (max(started) if started else (None, None))


def test_count_at_most(spark):
    rows = [([], 1), ([1], 0), ([1], 1), ([1, 1, 2, 5, 5, 9], 5), ([1, 1, 2, 5, 5, 9], 10), (list(range(100)), 63), (None, 1)]
    df = spark.createDataFrame(rows, "entries array<int>, value int")
    got = [r[0] for r in df.select(toolkit.count_at_most(F.col("entries"), F.col("value"))).collect()]
    assert got == [0, 0, 1, 5, 6, 64, 0]
