"""Validation of a run: attributes, registry failures, status counts, output index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.status import format_iso
from gridloom.operators.filters import failed_messages
from gridloom.operators.rules import attr_contract, failure_rollup, run_passed
from gridloom.operators.tasks import status_counts
from gridloom.shared import materialise
from gridloom.sources.sinks import index_lines, write_index


@dataclass(frozen=True)
class Validation:
    """Failures by source and message, the verdict on them, and tasks by status."""

    failures: DataFrame
    verdict: DataFrame
    statuses: DataFrame


def validate(files: DataFrame, datasets: DataFrame, registry: DataFrame, index_path: str, title: str) -> Validation:
    """Check every dataset's attributes and the registry, and write the index of ``files``.

    ``files`` has ``path, length``, ``datasets`` has ``path, attrs``.
    """
    failures = materialise(failure_rollup(attr_contract(datasets), failed_messages(registry)), "failures")
    verdict = run_passed(failures)
    n_failures = failures.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))).scalar()
    write_index(index_lines(files, n_failures, title, format_iso(F.current_timestamp())), index_path)
    return Validation(failures, verdict, status_counts(registry))
