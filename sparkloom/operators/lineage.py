"""Cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch that removes a query's shuffle files as soon as the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else that of spark.checkpoint.dir.

    Where the cluster names none there is an error, since executors could not read each
    other's local folders; a session on one machine gets a folder that ends with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write df to the shared folder and return it without its lineage.

    The shuffle files that df took are removed at once, and so are the checkpoints of
    spent: frames from this function that nothing else needs any more.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.select("*").checkpoint()
    finally:
        spark.conf.set(CLEANUP, before)
    for old in spent:
        release(old)
    return out


def written(df: DataFrame, *spent: str) -> tuple[DataFrame, str]:
    """(df as read back from Parquet in the shared folder, where it lies); the folders in spent are deleted once it stands."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/written-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(place)
    for old in spent:
        remove(spark, old)
    return spark.read.parquet(place), place


def remove(spark: SparkSession, place: str) -> None:
    """Delete a folder of the shared file system with all in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete the checkpoint that cut_lineage wrote for df, which must not be read again."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
