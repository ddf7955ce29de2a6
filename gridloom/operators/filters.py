"""Row filters on time, status, values, endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.status import is_active
from gridloom.functions.values import is_finite

# Prefixes of endpoints that still need configuration.
PLACEHOLDER_PREFIXES = ("REPLACE_", "REQUIRES_")


def _instant(df: DataFrame, column: str, value: str) -> Column:
    """Literal in the column's own time type, so that the filter reaches the scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def filter_date(df: DataFrame, start: str, end: str, column: str = "ts") -> DataFrame:
    """Rows in the half-open period ``[start, end)``.

    Where the table has a ``year`` partition column, the years are bounded too, which prunes folders.
    """
    kept = df.where((F.col(column) >= _instant(df, column, start)) & (F.col(column) < _instant(df, column, end)))
    if "year" in df.columns:
        kept = kept.where(F.col("year").between(int(start[:4]), int(end[:4])))
    return kept


def active_tasks(registry: DataFrame, status: str = "status", task: str = "task_id_or_file") -> DataFrame:
    """Started or running tasks that have an id to poll."""
    return registry.where(is_active(F.col(status)) & (F.coalesce(F.col(task), F.lit("")) != ""))


def failed_messages(registry: DataFrame, status: str = "status") -> DataFrame:
    """Messages of failed events, as text."""
    failed = registry.where((F.col(status) == "FAILED") & F.col("error_message").isNotNull())
    return failed.select(F.col("error_message").cast("string"))


def finite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is a number other than NaN and the infinities."""
    return df.where(is_finite(F.col(column)))


def needs_configuration(endpoint: Column) -> Column:
    return F.coalesce(
        endpoint.startswith(PLACEHOLDER_PREFIXES[0]) | endpoint.startswith(PLACEHOLDER_PREFIXES[1]), F.lit(False)
    )


def endpoint_gate(catalog: DataFrame) -> DataFrame:
    """External datasets whose endpoint is still a placeholder."""
    return catalog.where(needs_configuration(F.col("endpoint")))


def dry_run_gate(plan: DataFrame, dry_run: bool) -> DataFrame:
    """The plan as submitted: empty on a dry run."""
    return plan.where(F.lit(not dry_run))
