"""Counts kept per snapshot: a small append-only table, to which only snapshots not yet counted are added.

A row is (source_alias, label, side, dt, delivered_at, objects). A snapshot that was delivered again has a later
``delivered_at`` and gets another row; readers take the latest. Recording twice adds nothing, and a run that
failed half-way is repeated without harm.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowcheck.operators.snapshots import SNAPSHOT, bucket_counts
from stowcheck.operators.toolkit import broadcast_if_small, latest_per_group

SCHEMA = "source_alias string, label string, side string, dt string, delivered_at timestamp, objects bigint"
OF = [*SNAPSHOT, "dt"]


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row per counted snapshot, of its latest delivery; empty before the first recording."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return latest_per_group(rows, OF, ["delivered_at", "objects"])


def uncounted(catalogue: DataFrame, kept: DataFrame) -> DataFrame:
    """Snapshots of a catalogue that were never counted, or delivered again since."""
    return catalogue.select(*OF, "delivered_at").join(kept.select(*OF, "delivered_at"), [*OF, "delivered_at"], "left_anti")


def record_counts(inventory: DataFrame, catalogue: DataFrame, path: str) -> int:
    """Count the snapshots of ``catalogue`` that aren't counted yet; returns how many.

    Only their partitions are read. A delivered snapshot without rows is counted as 0.
    """
    spark = inventory.sparkSession
    todo = uncounted(catalogue, read_counts(spark, path)).collect()
    if not todo:
        return 0
    # one row per bucket, side and new delivery
    todo = spark.createDataFrame(todo, SCHEMA.rsplit(",", 1)[0]).where(F.col("dt") > "")
    rows = inventory.join(broadcast_if_small(todo.select(*OF)), OF, "left_semi")
    counted = todo.join(bucket_counts(rows), OF, "left").withColumn("objects", F.coalesce("objects", F.lit(0).cast("bigint")))
    counted.select(*OF, "delivered_at", "objects").coalesce(1).write.mode("append").parquet(path)
    return todo.count()
