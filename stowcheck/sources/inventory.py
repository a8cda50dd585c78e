"""Stored inventories and object listings."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowcheck import schemas
from stowcheck.functions.keys import symlink_dt, symlink_root
from stowcheck.operators.toolkit import KEY

# the shuffle files of a finished query go at once, not when the driver next collects garbage
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """All snapshots under ``root``; filters on dt, source_alias and side prune directories."""
    return spark.read.schema(schemas.INVENTORY).parquet(root)


def write_inventory(inventory: DataFrame, root: str, rows_per_file: int = 2_000_000) -> None:
    """Write snapshots, replacing only the partitions present in ``inventory``.

    Each task sorts and writes its own rows, so nothing is shuffled and a source with a third of all rows is written
    by as many tasks as read it; a file holds ``rows_per_file`` rows at most. Sorting by key narrows the row-group
    ranges that key filters have to read. Coalesce an ``inventory`` of many small tasks first: each writes a file per
    snapshot.
    """
    parts = schemas.INVENTORY_PARTITIONS
    (
        inventory.sortWithinPartitions(*parts, "key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "zstd")
        .partitionBy(*parts)
        .parquet(root)
    )


def store_bucketed(
    df: DataFrame,
    table: str,
    path: str,
    buckets: int,
    partitions: Sequence[str] = ("dt", "side"),
    by: Sequence[Column] | None = None,
    rows: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "overwrite",
) -> DataFrame:
    """Store keyed rows for repeated reconciliation, bucketed and sorted by (source_alias, label, key).

    Joins and aggregations on those columns then need no shuffle and no sort. Directories are
    split by (dt, side) only, so the files per snapshot are ``buckets``, however many sources there
    are; a filter on one source skips row groups, as files are sorted by it. Choose ``buckets`` by size:
    one task reads one bucket.

    Where a narrower form than the stored rows is at hand, pass it with ``by``, the three key columns as expressions
    of it, and ``rows``, which makes the stored rows of it: only the narrow form is shuffled. The files of that shuffle
    are removed with the write's end. ``mode`` "append" adds partitions that the table doesn't hold yet.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, *(by or KEY))
    writer = (rows(dealt) if rows else dealt).write.mode(mode).option("path", path).option("compression", "zstd")
    # keys are sorted: delta encoding keeps only what differs from the key before
    writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    if partitions:
        writer = writer.partitionBy(*partitions)
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.table(table)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under a path with size and time; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(
            F.col("path").alias("key"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("last_modified"),
        )
    )


def stored_partitions(spark: SparkSession, root: str) -> DataFrame:
    """(source_alias, side, dt) present under ``root``, from file names alone."""
    path = F.col("key")
    return (
        list_files(spark, root, "*.parquet")
        .select(*[
            F.regexp_extract(path, f"/{name}=([^/]+)/", 1).alias(name)
            for name in ("source_alias", "side", "dt")
        ])
        .distinct()
    )


def snapshot_paths(listing: DataFrame) -> DataFrame:
    """Delivery time and root of every delivered snapshot in a listing."""
    key = F.col("key")
    return listing.select(
        "key", symlink_dt(key).alias("dt"), symlink_root(key).alias("hive_root")
    ).where(F.col("dt").isNotNull())
