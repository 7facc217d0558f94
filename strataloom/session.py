"""Session factory and the two ways of cutting lineage that survive a lost executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "strataloom", shuffle_partitions: int | None = None, driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", driver_memory)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local-mode session may fall back to a folder of this machine; on a
    cluster an unset folder is an error instead of a silent local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = os.path.join(tempfile.gettempdir(), "strataloom-" + spark.sparkContext.applicationId)
    os.makedirs(folder, exist_ok=True)
    return "file://" + folder


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Unlike a cache it survives the loss of any executor, and unlike a local
    checkpoint it has no single copy on one executor. All tables of an application
    lie in one folder, which goes when the driver ends (``clear_cuts`` earlier). If
    ``tidy``, the shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{_cut_folder(spark)}/{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in _CLEANUP}
    for name in _CLEANUP if tidy else ():
        spark.conf.set(name, "true")
    try:
        # The plan is made anew, since it takes the settings when it is made.
        (df.select("*") if tidy else df).write.mode("error").parquet(path)
    finally:
        for name in _CLEANUP if tidy else ():
            spark.conf.set(name, before[name])
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


_CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
_folders: set[str] = set()


def _cut_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete_quietly, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is gone; the folder is the operator's to remove
        return


def release(table: DataFrame) -> None:
    """Delete the table behind a result of ``cut`` that no later plan reads."""
    _delete(table.sparkSession, table._cut_path)


def clear_cuts(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application."""
    _delete(spark, _cut_folder(spark))
