"""Work folder shared by driver and executors, and tables kept there.

Small derived tables (masks, hot keys, lookup tables) are written once instead of cached: the files outlive
executors, are read identically by every later stage, and give Catalyst a real size, so that
``spark.sql.autoBroadcastJoinThreshold`` alone decides between a broadcast and a shuffled join.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="gridloom-")
    return _local_folders[app]


def work_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_folder(spark)}/gridloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the work folder that no earlier run used."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is; one that is not there is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_work_tables(spark: SparkSession) -> None:
    """Delete what the application has kept in the shared folder; results not yet read are lost with it."""
    remove(spark, work_folder(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
