"""Task states, retry decisions and time stamps of the registry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States, error markers and delays in seconds.
ACTIVE = ("STARTED", "RUNNING")
TERMINAL = ("COMPLETED", "FAILED")
POLL_STATES = {"READY": "RUNNING", "CANCELLED": "FAILED"}
UNKNOWN = "UNKNOWN"
RETRY_MARKERS = ("429", "rate limit", "quota")
RETRY_DELAYS = (10, 60, 300)
MAX_RETRIES = 3


def map_status(state: Column) -> Column:
    """Registry status of a polled state; states without a mapping pass through."""
    mapped = state
    for polled, status in POLL_STATES.items():
        mapped = F.when(state == polled, F.lit(status)).otherwise(mapped)
    return mapped


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_active(status: Column) -> Column:
    return F.coalesce(status.isin(*ACTIVE), F.lit(False))


def is_retryable(message: Column) -> Column:
    """True where the message reports a rate limit or quota."""
    lowered = F.lower(message)
    found = F.lit(False)
    for marker in RETRY_MARKERS:
        found = found | lowered.contains(marker)
    return F.coalesce(found, F.lit(False))


def retry_delay(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt (0-based); the last delay repeats."""
    delays = F.array(*[F.lit(seconds) for seconds in RETRY_DELAYS])
    return F.element_at(delays, F.least(attempt, F.lit(len(RETRY_DELAYS) - 1)).cast("int") + 1)


def parse_iso(text: Column) -> Column:
    """Instant of an ISO-8601 string with offset; blank or malformed text gives NULL."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def format_iso(instant: Column) -> Column:
    """ISO-8601 UTC text with microseconds and a numeric offset."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def days_since_epoch(instant: Column) -> Column:
    """Whole days from 1970-01-01 to the calendar day of ``instant``."""
    return F.unix_date(instant.cast("date"))
