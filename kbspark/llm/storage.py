"""Files that the driver and all executors share.

Everything that outlives a task goes below the folder that the session names in
``spark.checkpoint.dir``.  Paths are URIs; executors open them through
``pyarrow.fs``, so that a local path, HDFS or an object store work alike.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..session import new_dir

__all__ = ["data_files", "filesystem", "materialise", "new_dir"]


def materialise(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: this cuts its lineage and survives lost executors."""
    return session.materialise(df, name)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The part files of a folder that Spark wrote; as many as it had tasks."""
    return sorted(spark.read.parquet(path).inputFiles())
