"""Status monitor over a stream of task events.

A monitor that is given a ``folder`` keeps its checkpoint and its polls there: a later call with the same folder reads
only the event files that came since, and goes on numbering the polls. Without one, a call starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.status import is_active, is_terminal
from gridloom.operators.tasks import latest_status, status_counts
from gridloom.shared import fresh_path, remove


def event_stream(spark: SparkSession, path: str, files_per_poll: int = 1000) -> DataFrame:
    """Event files as a stream; every poll takes the files that have arrived."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_poll).parquet(path)


def _drain(df: DataFrame, mode: str, keep: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a query over all that has arrived since its checkpoint, then stop."""
    query = (
        df.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()


def _batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch overwrites its own folder, so a batch that is run again leaves one copy."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return keep


def _polls(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Every poll kept in ``folder``, with those of this call, by ``batch``."""
    path = f"{folder}/polls"
    _drain(df, mode, _batch_sink(path), f"{folder}/checkpoint")
    return df.sparkSession.read.parquet(path)


def stream_status_counts(events: DataFrame, status: str = "status", folder: str | None = None) -> DataFrame:
    """Running count by status; returns every poll's counts with its ``batch``."""
    return _polls(status_counts(events, status), "complete", folder or fresh_path(events.sparkSession, "status-counts"))


def last_counts(polls: DataFrame) -> DataFrame:
    """Counts of the latest poll."""
    latest = polls.agg(F.max("batch")).scalar()
    return polls.where(F.col("batch") == latest).drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stream_latest_state(events: DataFrame, task: str, order: list[str], folder: str | None = None, status: str = "status") -> DataFrame:
    """One current row per task, folded over the polls.

    A poll combines its events per task before anything is sent and folds them into the state of the open tasks, the
    only one it reads. Tasks that a poll leaves in a terminal state are written once, as finished, and are no part of the
    state from then on; of the state itself the last two polls' copies are kept, the older one in case the newer is
    written again. So neither state nor files grow with the polls. A late event of a finished task opens it anew, and the newest
    row of a task by ``order`` wins in the result.
    """
    spark, columns = events.sparkSession, events.columns
    folder = folder or fresh_path(spark, "latest-state")
    path = f"{folder}/polls"

    def open_rows(batch_id: int) -> str:
        return f"{path}/batch={batch_id}/finished=false"

    def keep(batch: DataFrame, batch_id: int) -> None:
        own = latest_status(batch, task, order)
        if _exists(batch.sparkSession, open_rows(batch_id - 1)):
            before = batch.sparkSession.read.schema(events.schema).parquet(open_rows(batch_id - 1))
            own = latest_status(own.unionByName(before), task, order)
        told = own.withColumn("finished", F.coalesce(is_terminal(F.col(status)), F.lit(False)))
        told.hint("rebalance", "finished").write.mode("overwrite").partitionBy("finished").parquet(f"{path}/batch={batch_id}")
        # A folder of open rows only goes as a whole.
        finished = f"{path}/batch={batch_id - 2}/finished=true"
        remove(batch.sparkSession, open_rows(batch_id - 2) if _exists(batch.sparkSession, finished) else f"{path}/batch={batch_id - 2}")

    _drain(events, "append", keep, f"{folder}/checkpoint")
    if not _exists(spark, path):
        return spark.createDataFrame([], events.schema)
    kept = spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(path)
    return latest_status(kept, task, order).select(*columns)


def drain_report(latest: DataFrame, status: str = "status") -> DataFrame:
    """After draining: tasks seen, tasks still active, and whether monitoring may stop."""
    return latest.agg(F.count("*").alias("n_tasks"), F.count_if(is_active(F.col(status))).alias("n_active")).withColumn(
        "finished", F.col("n_active") == 0
    )
