"""Task registry: append-only CSV events with a fixed header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.status import format_iso, parse_iso
from gridloom.schemas import REGISTRY_COLUMNS, REGISTRY_TEXT, REGISTRY_TIMES

_COUNTS = {"n_bytes": "bigint", "retries": "int"}


def typed(text: DataFrame) -> DataFrame:
    """Registry text columns as instants, numbers and strings; blanks are NULL."""
    return text.select(*[_typed_column(name) for name in REGISTRY_COLUMNS])


def _typed_column(name: str) -> Column:
    blank_free = F.nullif(F.col(name), F.lit(""))
    if name in REGISTRY_TIMES:
        return parse_iso(F.col(name)).alias(name)
    if name in _COUNTS:
        # Numbers may carry a decimal point, as in a column that once held blanks; what is no number is NULL.
        whole = F.coalesce(blank_free.try_cast("bigint"), blank_free.try_cast("decimal(38,6)").try_cast("bigint"))
        return whole.try_cast(_COUNTS[name]).alias(name)
    return blank_free.alias(name)


# What appended files hold in place of a backslash and of line breaks, so that every line is one event.
_BREAKS = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}


def _one_line(value: Column) -> Column:
    for plain, written in _BREAKS.items():
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def _with_breaks(value: Column) -> Column:
    """Undo ``_one_line``: a doubled backslash is set aside while the breaks are put back."""
    aside = F.replace(value, F.lit("\\\\"), F.lit("\0"))
    for plain in ("\n", "\r"):
        aside = F.replace(aside, F.lit(_BREAKS[plain]), F.lit(plain))
    return F.replace(aside, F.lit("\0"), F.lit("\\"))


def registry(spark: SparkSession, path: str, foreign: bool = False) -> DataFrame:
    """All events below ``path``, one or many CSV files with the fixed header.

    Files that ``append_event`` wrote hold one event a line and are split among tasks. ``foreign`` files may hold line
    breaks inside values, so each of them is read by one task.
    """
    options = {"header": True, "nullValue": "", "escape": '"', "multiLine": foreign}
    text = spark.read.schema(REGISTRY_TEXT).options(**options).csv(path)
    return typed(text if foreign else text.select(*[_with_breaks(F.col(c)).alias(c) for c in text.columns]))


def event_columns(events: DataFrame) -> DataFrame:
    """Normalised events: the fixed columns in order, absent ones blank, time stamp defaulting to now."""
    present = set(events.columns)

    def column(name: str) -> Column:
        value = F.col(name) if name in present else F.lit(None)
        if name == "timestamp":
            value = F.coalesce(value.cast("timestamp"), F.current_timestamp())
        if name in REGISTRY_TIMES:
            value = format_iso(value.cast("timestamp"))
        return _one_line(value.cast("string")).alias(name)

    return events.select(*[column(name) for name in REGISTRY_COLUMNS])


def append_event(events: DataFrame, path: str) -> None:
    """Append events as new files; nothing already written is touched."""
    event_columns(events).write.mode("append").csv(path, header=True, nullValue="", emptyValue="", escape='"')
