"""Session settings for tests and the bench; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tillscope") -> SparkSession:
    threads = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.sql.files.minPartitionNum", str(threads))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    Where the session names none (a local run), a new temporary folder is made once and set as the
    checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillscope-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no earlier write has used, in this application's own folder under the shared one."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}/{name}"


def run_folder(spark: SparkSession) -> str:
    """This application's own folder under the shared one; all that is settled lies in it."""
    return f"{shared_folder(spark).rstrip('/')}/tillscope/{spark.sparkContext.applicationId}"


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it lies; False where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def content_mark(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files at a path, from which a change of its content can be told."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files = store.listStatus(place)
    return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in files))


def drop_run(spark: SparkSession) -> bool:
    """Delete all that this application has settled. For the end of a run: frames that read it can no longer be used."""
    return remove_folder(spark, run_folder(spark))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once under the shared folder, so that all its readers see the same rows."""
    path = fresh_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
