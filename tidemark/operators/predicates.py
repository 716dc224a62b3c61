"""Which rows a job selects. Every comparison with the boundary is strict: a row at it is left alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import DELETED, LOCK_NONE, LOCK_READ, LOCK_WRITE, PREPARED


def needs_finalization(boundary_ms: int, state: str = "tx_state", at: str = "tx_prepared_at") -> Column:
    """In-doubt records older than the boundary. A null state counts as committed, a null time as not older."""
    return F.coalesce(F.col(state).isin(PREPARED, DELETED) & (F.col(at) < boundary_ms), F.lit(False))


def needs_release(boundary_ms: int, kind: str = "lock_type", at: str = "last_updated_at") -> Column:
    """Read locks of any age and write locks older than the boundary.

    An unknown or null lock type, and a write lock without a time, fail the job.
    """
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.coalesce(F.col(kind).cast("string"), F.lit("null")))).cast("boolean")
    older = F.when(F.col(at).isNull(), fail("a write lock has no time; its type is ")).otherwise(F.col(at) < boundary_ms)
    return (
        F.when(F.col(kind) == LOCK_NONE, False).when(F.col(kind) == LOCK_READ, True).when(F.col(kind) == LOCK_WRITE, older).otherwise(fail("unknown lock type "))
    )


def older_than(column: str, boundary_ms: int) -> Column:
    """Rows with a time before the boundary; a null time is never before it."""
    return F.coalesce(F.col(column) < boundary_ms, F.lit(False))


def coordinator_deletable(boundary_ms: int) -> Column:
    """Whatever the outcome of the transaction."""
    return older_than("tx_created_at", boundary_ms)


def proof_deletable(boundary_ms: int) -> Column:
    return older_than("registered_at", boundary_ms)


def guarded(key: str, selected: Column) -> Column:
    """The key; null on a selected row fails the job."""
    return F.when(selected & F.col(key).isNull(), F.raise_error(F.lit(f"a selected row has no {key}"))).otherwise(F.col(key))
