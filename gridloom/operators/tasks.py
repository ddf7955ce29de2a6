"""Task registry queries: latest state, counts, polls, retries, admission, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.status import (
    MAX_RETRIES,
    UNKNOWN,
    is_active,
    is_retryable,
    is_terminal,
    map_status,
    retry_delay,
)
from gridloom.operators.filters import needs_configuration
from gridloom.operators.skew import row_number_by

DEFAULT_CAP = 20


def latest_status(events: DataFrame, task: str, order: list[str]) -> DataFrame:
    """The last event of every task.

    An aggregate, not a window: each map task sends one row per task id, also when one id has most events.
    """
    others = [name for name in events.columns if name != task]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return events.groupBy(task).agg(last).select(task, "_last.*").select(*events.columns)


def status_counts(registry: DataFrame, status: str = "status") -> DataFrame:
    return registry.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def active_count(registry: DataFrame, status: str = "status") -> DataFrame:
    """One row: the number of started or running rows, 0 for an empty registry."""
    return registry.agg(F.count_if(is_active(F.col(status))).alias("n_active"))


def poll_merge(registry: DataFrame, polls: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Registry with polled states applied to its active rows.

    ``polls`` has ``task, state, polled_at, error_message``; the latest poll of a task counts. Status is mapped,
    the end time set only by a terminal state (and cleared by any other), the error replaced; a poll without a state
    gives UNKNOWN. Other rows stay.
    """
    needed = polls.select(*dict.fromkeys([task, "state", "polled_at", "error_message", *order]))
    latest = latest_status(needed, task, order).select(
        task,
        map_status(F.coalesce("state", F.lit(UNKNOWN))).alias("_status"),
        F.col("polled_at").alias("_polled_at"),
        F.col("error_message").alias("_error"),
    )
    polled = is_active(F.col("status")) & F.col("_status").isNotNull() & (F.col(task) != "")
    ended = F.when(is_terminal(F.col("_status")), F.col("_polled_at"))
    return (
        registry.join(latest, task, "left")
        .withColumns(
            {
                "end_time": F.when(polled, ended).otherwise(F.col("end_time")),
                "error_message": F.when(polled, F.col("_error")).otherwise(F.col("error_message")),
                "status": F.when(polled, F.col("_status")).otherwise(F.col("status")),
            }
        )
        .drop("_status", "_polled_at", "_error")
    )


def retry_ladder(failures: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Attempt number (0-based), retryable flag, outcome and delay of every failed attempt.

    A retryable failure is RETRIED after its delay until the third retry has failed; any other is FAILED.
    """
    numbered = row_number_by(failures, [task], order, "_nth")
    attempt = F.col("_nth") - 1
    retryable = is_retryable(F.col("error_message"))
    retried = retryable & (attempt < MAX_RETRIES)
    return numbered.withColumns(
        {
            "attempt": attempt,
            "retryable": retryable,
            "outcome": F.when(retried, "RETRIED").otherwise("FAILED"),
            "delay_s": F.when(retried, retry_delay(attempt)),
        }
    ).drop("_nth")


def admission_list(plan: DataFrame, registry: DataFrame, task: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """Next pending tasks, in task order, that fit under the cap beside the active ones.

    At most ``cap`` rows can be admitted, so a top-``cap`` sort is all that is ordered.
    """
    pending = plan.join(registry.select(task).distinct(), task, "left_anti")
    first = pending.orderBy(task).limit(cap)
    slots = first.withColumn("slot", F.row_number().over(Window.orderBy(task)))
    return slots.where(F.col("slot") <= F.lit(cap) - active_count(registry).scalar())


def run_report(catalog: DataFrame, registry: DataFrame, dry_run: bool = False) -> DataFrame:
    """Tasks per dataset and the label of the run.

    ``registry`` has a row per queued task or file with its ``dataset_id``; it is counted before the join.
    """
    counted = registry.groupBy("dataset_id").agg(F.count("*").alias("n_tasks"))
    joined = catalog.select("dataset_id", "name", "family", "endpoint").join(counted, "dataset_id", "left")
    n_tasks = F.lit(0).cast("bigint") if dry_run else F.coalesce("n_tasks", F.lit(0).cast("bigint"))
    raster = F.lit("DRY_RUN_NO_EXPORT") if dry_run else F.when(n_tasks > 0, "QUEUED").otherwise("FAILED_OR_NOT_RUN")
    unconfigured = needs_configuration(F.col("endpoint")) | (n_tasks == 0)
    external = F.when(unconfigured, "CONFIGURATION_REQUIRED").otherwise("COMPLETED")
    label = F.when(F.col("family") == "raster", raster).otherwise(external)
    return joined.select("dataset_id", "name", "family", n_tasks.alias("n_tasks"), label.alias("status"))
