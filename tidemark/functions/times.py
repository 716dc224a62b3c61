"""Epoch milliseconds. Times are literals that the driver takes once, never functions inside a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import LOCK_VALID_MS

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_ms(column: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, CAST({column} AS TIMESTAMP_NTZ))")


def instant(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def lock_boundary(now_ms: int, valid_ms: int = LOCK_VALID_MS) -> int:
    return now_ms - valid_ms
