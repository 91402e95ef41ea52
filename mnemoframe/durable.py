"""Cutting lineage in the folder that the cluster shares.

The folder is read from ``spark.checkpoint.dir``. Only where that is unset and all of Spark runs in
one process (tests, a single machine) does this module choose one; a cluster has to name it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode a temporary one is set where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="mnemoframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _file_system(spark, path)
    return store.exists(where)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of its file system."""
    store, where = _file_system(spark, path)
    return store.makeQualified(where).toString()


def entries_of(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    store, where = _file_system(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def deleted(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        store, where = _file_system(spark, path)
        store.delete(where, True)


#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def as_table(df: DataFrame, name: str = "cut", freed: bool = False, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to a parquet table in the shared folder and read it back.

    ``freed`` deletes the shuffle files of the writing as soon as it ends. A file has at most ``rows_per_file`` rows, if that isn't 0.

    The lineage ends there, so that a lost executor costs nothing. Unlike a checkpointed RDD the
    table is compressed and column-pruned by its readers, has a size that the optimizer
    knows, and doesn't carry the constraints of the plan that made it, which double with every
    round of a loop.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(_CLEANUP)
    df.sparkSession.conf.set(_CLEANUP, "true" if freed else before)
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        df.sparkSession.conf.set(_CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._mnemoframe_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`as_table` that nothing reads any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_mnemoframe_path", None)
        if path:
            deleted(table.sparkSession, path)
