"""Intermediate results that survive the loss of executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for what driver and executors share, which the session names in spark.checkpoint.dir. Where it names
    none, a local folder is set if Spark runs in one process, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = os.path.join(os.environ.get("TMPDIR", "/tmp"), "seqloom-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, with their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A name for a folder of its own within the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/seqloom-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, written as Parquet at a path in a shared folder, of which later reads take only the columns they use."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    system, place = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)
