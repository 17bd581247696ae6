"""Session helpers shared by the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one batch handed to a Python worker.
ARROW_BYTES = "8m"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make a session ready for this package: Python workers can import it, and get batches of bounded size."""
    # A batch for Python is bounded by bytes, whatever the length of its texts.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        here = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="kbspark-"), "kbspark.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        out.write(path, os.path.relpath(path, os.path.dirname(here)))
        spark.sparkContext.addPyFile(name)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; a temporary one only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
            spark.sparkContext.setCheckpointDir(root)
    root = qualified(spark, root)
    # Hadoop writes a local folder as file:/x; here it is file:///x, whoever set it.
    return f"file:///{root[5:].lstrip('/')}" if root.startswith("file:") else root


def qualified(spark: SparkSession, root: str) -> str:
    """A folder as a URI: a plain path is one of the cluster's default file system, as Hadoop takes it."""
    if "://" in root or root.startswith("file:"):
        return root
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name for one run of one job; nothing is reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{new_dir(spark, name)}/table"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_parts(df: DataFrame, name: str, parts: int, *by: str) -> list[str]:
    """Write a table to the shared folder as so many files, by ranges of ``by`` if given, which tasks read by themselves (``read_part``)."""
    spark = df.sparkSession
    path = f"{new_dir(spark, name)}/table"
    (df.repartitionByRange(parts, *by) if by else df.repartition(parts)).write.parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def read_part(uri: str) -> pa.Table:
    """One file of ``shared_parts``, read in a task from wherever the shared folder is."""
    files, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    return pq.read_table(path, filesystem=files, partitioning=None)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """``over_all_cores``, where the input itself has too few parts to keep them busy."""
    return df if df.rdd.getNumPartitions() >= 4 * df.sparkSession.sparkContext.defaultParallelism else over_all_cores(df, *keys)


def over_all_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash of ``keys`` over all cores, for work that is heavy for its bytes: adaptive coalescing would give it to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
