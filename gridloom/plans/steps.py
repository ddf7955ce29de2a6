"""Audited steps: run a step and record its outcome."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.shared import materialise
from gridloom.sources.registry import append_event

_EVENT = (
    "notebook_id STRING, dataset STRING, task_id_or_file STRING, pathway STRING, status STRING, "
    "start_time TIMESTAMP, end_time TIMESTAMP, error_message STRING"
)


def audited_step(
    spark: SparkSession,
    step: Callable[[], DataFrame],
    registry_path: str,
    notebook_id: str,
    dataset: str,
    empty_schema: str,
    pathway: str = "xee",
    name: str | None = None,
) -> DataFrame:
    """Run a step that returns a DataFrame, write its result, and append a COMPLETED or FAILED event.

    The result is written to the shared folder, so a failure shows here and later use does not run the step
    again. A failed step gives an empty table of ``empty_schema``.
    """
    started = dt.datetime.now(dt.timezone.utc)
    try:
        result, status, error = materialise(step(), "step"), "COMPLETED", None
    except Exception as failure:  # noqa: BLE001 - any failure of the step is recorded, none is raised
        result, status, error = spark.createDataFrame([], empty_schema), "FAILED", str(failure)
    ended = dt.datetime.now(dt.timezone.utc)
    task = name or getattr(step, "__name__", "step")
    event = (notebook_id, dataset, task, pathway, status, started, ended, error)
    append_event(spark.createDataFrame([event], _EVENT), registry_path)
    return result
