"""Session settings the operators rely on, and the shared work folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings only: a cluster's own sizing (executors, shuffle partitions) is left alone.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # dt stays a string, so partitions compare the way their names sort
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # skip the sorts of a sort-merge join when every post-shuffle partition is small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # a bucketed snapshot holds one sorted file per bucket: merge joins over it need no sort
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # measured on compressed shuffle data, several times smaller than the broadcast table
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "4MB",
    # the same for sizes estimated from compressed Parquet files
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # the shuffle files of a query go when it ends, not when the driver next collects garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # streaming state beside the heap, for all streams
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Python data sources are asked which filters they apply themselves
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stowcheck")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs more than building the queries
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_local_root: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where the setting is usually unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_root:
        _local_root[context.applicationId] = tempfile.mkdtemp(prefix="stowcheck-")
    return _local_root[context.applicationId]


def work_path(spark: SparkSession, name: str) -> str:
    """A new, not yet existing path below the work folder."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
