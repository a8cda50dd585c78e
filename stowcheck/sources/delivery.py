"""Snapshots as an inventory service delivers them: Parquet data files, and per snapshot a ``symlink.txt``.

The symlink file of a snapshot lies at inventory/<alias>/<side>/<bucket>/<bucket>/<id>/hive/dt=<dt>/ and names the
data files, one to a line. Data files carry no alias, side, label or dt; those come from the symlink's path and
the registry. File names pass the driver, as they do in any Parquet scan; contents are read by Spark's own Parquet
reader, so files are split, columns pruned and filters pushed as in a stored table.
"""

import posixpath
from functools import reduce
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowcheck import schemas
from stowcheck.functions.keys import delivery_fields
from stowcheck.operators.snapshots import SNAPSHOT
from stowcheck.operators.toolkit import per_source
from stowcheck.sources.inventory import list_files

SYMLINK = "symlink.txt"
DATA_COLUMNS = [
    "bucket", "key", "version_id", "is_latest", "is_delete_marker", "size", "last_modified_date", "e_tag",
    "storage_class", "checksum_algorithm",
]


def list_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Symlink files under ``root`` (key, size, last_modified): what ``delivery_catalogue`` reads."""
    return list_files(spark, root, SYMLINK)


def named_files(spark: SparkSession, root: str, snapshots: DataFrame) -> DataFrame:
    """(source_alias, label, side, dt, file): the data files that the symlinks of ``snapshots`` name.

    ``snapshots``: rows of a delivery catalogue (source_alias, label, side, bucket, dt). Blank lines are skipped.
    A data file that two lines of a snapshot name counts once.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", SYMLINK).text(root)
        .select(F.trim("value").alias("file"), delivery_fields(F.col("_metadata.file_path")).alias("_of"))
        .where((F.col("file") != "") & F.col("_of").isNotNull())
        .select("file", "_of.*")
    )
    wanted = snapshots.select(*SNAPSHOT, "bucket", "dt").distinct()
    return lines.join(per_source(wanted), ["source_alias", "side", "bucket", "dt"]).select(*SNAPSHOT, "dt", "file").distinct()


def read_delivered(spark: SparkSession, root: str, snapshots: DataFrame, scheme: str | None = None) -> DataFrame:
    """Inventory rows of ``snapshots``, read from the data files their symlinks name.

    Each snapshot is a scan of its own with alias, label, side and dt as constants, so a filter on any of them
    drops whole scans while the query is planned. There are as many scans as configured buckets and sides, times
    the days asked for. ``scheme`` replaces the one of the named files (``s3a`` for ``s3``, say). A named file that
    is missing is an error.
    """
    named = named_files(spark, root, snapshots).groupBy(*SNAPSHOT, "dt").agg(F.array_sort(F.collect_list("file")).alias("files"))
    schema = [schemas.INVENTORY[name] for name in DATA_COLUMNS]
    kinds = type(schemas.INVENTORY)(schema)

    def scan(row) -> DataFrame:
        files = [urlsplit(f)._replace(scheme=scheme).geturl() if scheme else f for f in row["files"]]
        constant = {name: F.lit(row[name]) for name in (*SNAPSHOT, "dt")}
        return spark.read.schema(kinds).parquet(*files).withColumns(constant)

    scans = [scan(row) for row in named.orderBy(*SNAPSHOT, "dt").collect()]
    if not scans:
        return spark.createDataFrame([], schemas.INVENTORY)
    return reduce(DataFrame.unionByName, scans).select(*schemas.INVENTORY.names)


def deliver(inventory: DataFrame, root: str, delivery: str = "daily") -> None:
    """Write snapshots under ``root`` in the delivered form: data files by the executors, then the symlinks.

    A reader sees a snapshot once its symlink stands, which is written last. ``root`` is new.
    """
    of = {f"of_{name}": F.col(name) for name in ("source_alias", "side", "bucket", "dt")}
    columns = [c if c in inventory.columns else F.lit(None).cast(schemas.INVENTORY[c].dataType).alias(c) for c in DATA_COLUMNS]
    # each task writes its own rows: the files of a snapshot are as many as the tasks that read it
    inventory.withColumns(of).select(*columns, *of).write.partitionBy(*of).option("compression", "zstd").parquet(f"{root}/data")
    path = F.col("key")
    files = list_files(inventory.sparkSession, f"{root}/data", "*.parquet").select(
        path.alias("file"), *[F.regexp_extract(path, f"/{name}=([^/]+)/", 1).alias(name) for name in of]
    )
    system, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
    for row in files.groupBy(*of).agg(F.array_sort(F.collect_list("file")).alias("files")).collect():
        alias, side, bucket, dt = (row[name] for name in of)
        folder = posixpath.join(base, "inventory", alias, side, bucket, bucket, delivery, "hive", f"dt={dt}")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(posixpath.join(folder, SYMLINK)) as out:
            out.write("".join(f"{name}\n" for name in row["files"]).encode())
