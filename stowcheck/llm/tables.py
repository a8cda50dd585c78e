"""Tables of one data folder, and intermediate tables in the shared work folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from stowcheck.session import work_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """``df`` written once to the folder all executors share: later reads don't depend on any executor.

    ``scratch`` gets the path of a table that ``drop_tables`` is to remove.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of a path in any store that pyarrow reaches."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def drop_tables(paths: list[str]) -> None:
    """Remove tables of ``stored`` that nothing reads any more: what was made of them must itself be stored."""
    while paths:
        system, name = open_path(paths.pop())
        system.delete_dir(name)


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    The driver's import path says nothing about theirs.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="stowcheck-code-")) / "stowcheck.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
