"""Published snapshots: readers see a snapshot only when it is whole, and a later run of its day replaces it.

A run writes its rows to a folder of its own and then appends one row to the list of published runs, a single
file that the commit protocol puts in place at once. Readers take the last run listed for each dt. A run that
fails before that leaves what readers see as it was; repeating a run that is listed does nothing, repeating
one that isn't writes its folder anew. One run at a time publishes to a root.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUNS = "sequence bigint, dt string, run string"


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every published run in order; empty when nothing has been published."""
    try:
        return spark.read.schema(RUNS).json(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)


def publish_snapshot(snapshot: DataFrame, root: str, dt: str, run: str) -> bool:
    """Write ``snapshot`` and make it the one that readers see for ``dt``; False if this run is listed already."""
    spark = snapshot.sparkSession
    runs = published_runs(spark, root)
    if not runs.where((F.col("dt") == dt) & (F.col("run") == run)).isEmpty():
        return False
    stage_snapshot(snapshot, root, dt, run)
    last = runs.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    spark.createDataFrame([(last + 1, dt, run)], RUNS).coalesce(1).write.mode("append").json(f"{root}/published")
    return True


def stage_snapshot(snapshot: DataFrame, root: str, dt: str, run: str) -> None:
    """Write the rows of a run, which no reader sees yet."""
    snapshot.write.mode("overwrite").parquet(_folder(root, dt, run))


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the last published run of every dt, with ``dt`` as text. Only folders of those runs are listed."""
    newest = published_runs(spark, root).groupBy("dt").agg(F.max_by("run", "sequence").alias("run"))
    # one row per delivered day
    folders = [_folder(root, r["dt"], r["run"]) for r in newest.orderBy("dt").collect()]
    if not folders:
        raise FileNotFoundError(f"nothing has been published in {root}")
    rows: StructType = spark.read.parquet(folders[-1]).schema
    schema = StructType([*rows.fields]).add("dt", "string").add("run", "string")
    return spark.read.schema(schema).option("basePath", f"{root}/runs").parquet(*folders).drop("run")


def _folder(root: str, dt: str, run: str) -> str:
    return f"{root}/runs/dt={dt}/run={run}"
