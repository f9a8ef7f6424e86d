"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session within one machine may leave it unset; it then gets a folder of that machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/chunkwell-{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{_folder(spark)}/chunkwell/{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # only of what is there
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def stored(df: DataFrame, free: bool = False, codec: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage, and survives lost executors.

    ``free``: the shuffle files of the writing are deleted when it ends, not when the driver happens to collect its garbage. ``codec``: of the
    files, else the session's.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, str(free or before == "true").lower())
    try:
        df.write.mode("overwrite").parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Deletes what ``stored`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)
