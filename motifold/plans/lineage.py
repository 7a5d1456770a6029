"""Cutting the lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of written tables.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one in local mode (tests), an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="motifold-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    context.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or by sweep()."""
    root = f"{shared_dir(spark)}/motifold-{spark.sparkContext.applicationId}"
    path, files = _path(spark, root)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again; to a `path` of scratch(), add it to what is there and read it all.

    Whatever executor is lost later, the rows are neither computed again nor able to change. The table goes
    when the driver ends, or before by release() or sweep().
    """
    spark = df.sparkSession
    name = path or scratch(spark)
    # rows can be large: small row groups, whose size is looked at often, keep writers and readers small
    df.write.mode("append").options(**{"compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.block.size.row.check.min": "8", "parquet.page.size.row.check.min": "8"}).parquet(name)
    out = spark.read.schema(df.schema).parquet(name)
    out.written_to = name
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that cut() gave and that nothing reads any more."""
    for table in tables:
        path, files = _path(table.sparkSession, table.written_to)
        files.delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables written by this application; what reads them ends with them."""
    path, files = _path(spark, f"{shared_dir(spark)}/motifold-{spark.sparkContext.applicationId}")
    files.delete(path, True)
