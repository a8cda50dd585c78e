"""Manifest, stage, export and restore outputs. Executors write; nothing passes the driver."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stowcheck import schemas
from stowcheck.sources.events import TIME_FORMAT


def write_manifest(manifest: DataFrame, path: str) -> int:
    """Headerless, unquoted, uncompressed ``bucket,key`` part files per source.

    Keys are encoded, so neither commas nor quotes occur. Rows are counted by the same job. An
    empty manifest writes no part file.
    """
    counted = Observation("manifest")
    (
        manifest.observe(counted, F.count(F.lit(1)).alias("rows"))
        .select("source_alias", "bucket", "key")
        .write.mode("overwrite")
        .option("header", False)
        .option("quote", "")
        .option("compression", "none")
        .partitionBy("source_alias")
        .csv(path)
    )
    return int(counted.get["rows"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("bucket string, key string, source_alias string")
        .option("header", False)
        .option("quote", "")
        .csv(path)
    )


def manifest_parts(manifest: DataFrame) -> DataFrame:
    """Part files of a stored manifest with rows and bytes. The parts stay distributed."""
    return manifest.groupBy(
        "source_alias",
        F.col("_metadata.file_path").alias("part"),
        F.col("_metadata.file_size").alias("bytes"),
    ).agg(F.count("*").alias("rows"))


def write_stage(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions in ``df``; the commit protocol clears leftovers of a failed run."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_with_rejects(df: DataFrame, path: str, reason: Column) -> tuple[int, int]:
    """Write rows whose ``reason`` is NULL as good and the others as rejected, in one pass; the number of both."""
    counted = Observation("rejects")
    marked = df.withColumn("reason", reason)
    rejected = F.col("reason").isNotNull()
    (
        marked.withColumn("outcome", F.when(rejected, "rejected").otherwise("good"))
        .observe(counted, F.count_if(~rejected).alias("good"), F.count_if(rejected).alias("rejected"))
        .write.mode("overwrite")
        .partitionBy("outcome")
        .parquet(path)
    )
    return int(counted.get["good"]), int(counted.get["rejected"])


def read_good(like: DataFrame, path: str) -> DataFrame:
    """The good rows that ``write_with_rejects`` wrote; columns are those of ``like``."""
    return _outcome(like, path, "good").drop("reason")


def read_rejects(like: DataFrame, path: str) -> DataFrame:
    """The rejected rows with their ``reason``."""
    return _outcome(like, path, "rejected")


def _outcome(like: DataFrame, path: str, outcome: str) -> DataFrame:
    # given, as an empty table leaves no file to take it from
    schema = StructType([*like.schema.fields]).add("reason", "string").add("outcome", "string")
    return like.sparkSession.read.schema(schema).parquet(path).where(F.col("outcome") == outcome).drop("outcome")


def export_table_snapshot(df: DataFrame, root: str, table: str, day: str) -> DataFrame:
    """Full snapshot as JSON under ``<root>/<table>/YYYY/MM/DD``; returns its status row.

    An existing export of that day is an error.
    """
    prefix = f"{table}/{day.replace('-', '/')}"
    counted = Observation("export")
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").option(
        "timestampFormat", TIME_FORMAT
    ).json(f"{root}/{prefix}")
    return df.sparkSession.createDataFrame(
        [(table, prefix, "COMPLETED", int(counted.get["rows"]))],
        "table_name string, export_prefix string, status string, rows bigint",
    )


def restore_to_new_table(df: DataFrame, root: str, table: str, force: bool = False) -> str:
    """Write a restored state under the table's restore name; an existing one fails unless forced."""
    from stowcheck.constants import MAX_TABLE_NAME, RESTORE_SUFFIX

    target = f"{root}/{table[: MAX_TABLE_NAME - len(RESTORE_SUFFIX)]}{RESTORE_SUFFIX}"
    df.write.mode("overwrite" if force else "errorifexists").parquet(target)
    return target


def read_job_report(spark: SparkSession, path: str) -> DataFrame:
    """Task report of a copy job: quoted CSV without header."""
    return spark.read.schema(schemas.JOB_REPORT).option("header", False).csv(path)


def append_run_state(states: DataFrame, path: str) -> None:
    states.write.mode("append").parquet(path)


def stamp(states: DataFrame, checked_at: Column, status: str) -> DataFrame:
    """Run-state rows for buckets entering a phase."""
    return states.withColumns({"checked_at": checked_at, "status": F.lit(status)})
