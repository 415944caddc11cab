"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution's shuffle files are removed at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that still exist, each with the session that wrote it; the rest of them go when the driver ends.
_WRITTEN: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on a single machine (tests), a temporary folder is set first."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        where = context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(where)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is removed when the driver ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_all)
    _WRITTEN[path] = spark
    return path


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder, read again: computed once, without its lineage.

    The shuffle files behind it go as soon as it is written.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(frame.schema).parquet(path)
    out.written_path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned, once nothing reads them any more."""
    for table in tables:
        _remove(table.written_path)


def _remove(path: str) -> None:
    spark = _WRITTEN.pop(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove_all() -> None:
    for path in list(_WRITTEN):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session is gone, and its folder is the cluster's to clear
            return
