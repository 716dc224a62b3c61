"""What becomes of in-doubt records: one join with the transactions' outcomes instead of a lookup per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import needs_finalization
from tidemark.operators.prefilter import matching
from tidemark.schemas import ABORTED, COMMITTED, LEDGER, PREPARED, TableSpec

KEEP, SKIP, ROLL_FORWARD, REMOVE = "KEEP", "SKIP", "ROLL_FORWARD", "REMOVE"
ROLLBACK_REMOVE, ROLLBACK_RESTORE = "ROLLBACK_REMOVE", "ROLLBACK_RESTORE"
EXPIRY_MS = 15_000
#: (records, coordinator, boundary, now) to the records with c_state and action.
Recovery = Callable[[DataFrame, DataFrame, int, int], DataFrame]


def outcomes(candidates: DataFrame, coordinator: DataFrame) -> DataFrame:
    """(tx_id, c_state) of the candidates' transactions only; the coordinator table is scanned but not shuffled."""
    return matching(coordinator.select("tx_id", "c_state"), candidates, "tx_id")


def _action(now_ms: int, expiry_ms: int, inserted: Column) -> Column:
    state, outcome = F.col("tx_state"), F.col("c_state")
    back = F.when((state == PREPARED) & inserted, ROLLBACK_REMOVE).otherwise(ROLLBACK_RESTORE)
    return (
        F.when(outcome == COMMITTED, F.when(state == PREPARED, ROLL_FORWARD).otherwise(REMOVE))
        .when(outcome == ABORTED, back)
        .when(F.lit(now_ms) - F.col("tx_prepared_at") < expiry_ms, SKIP)
        .otherwise(back)
    )


def resolve(
    records: DataFrame, coordinator: DataFrame, boundary_ms: int, now_ms: int, expiry_ms: int = EXPIRY_MS, spec: TableSpec = LEDGER, thin: bool = False
) -> DataFrame:
    """The records with c_state and action.

    Only in-doubt records older than the boundary take part in the join; the others are kept as they
    are without being shuffled. ``thin`` counts the candidates first and thins out the coordinator table by
    their ids before the join.
    """
    chosen = needs_finalization(boundary_ms)
    candidates = records.where(chosen)
    found = outcomes(candidates, coordinator) if thin else coordinator.select("tx_id", "c_state")
    inserted = F.lit(True)
    for column in spec.before.values():
        inserted = inserted & F.col(column).isNull()
    judged = candidates.join(found, "tx_id", "left").withColumn("action", _action(now_ms, expiry_ms, inserted))
    rest = records.where(~chosen).withColumns({"c_state": F.lit(None).cast("string"), "action": F.lit(KEEP)})
    return judged.select(*records.columns, "c_state", "action").unionByName(rest)


def applied(resolved: DataFrame, spec: TableSpec = LEDGER) -> DataFrame:
    """The records after their actions: committed, restored or gone; kept and skipped ones as they were."""
    stay = resolved.where(~F.col("action").isin(REMOVE, ROLLBACK_REMOVE))
    restore = F.col("action") == ROLLBACK_RESTORE
    changed = {c: F.when(restore, F.col(b)).otherwise(F.col(c)) for c, b in spec.before.items()}
    changed["tx_state"] = F.when(F.col("action").isin(ROLL_FORWARD, ROLLBACK_RESTORE), COMMITTED).otherwise(F.col("tx_state"))
    return stay.withColumns(changed).drop("c_state", "action")


def new_aborts(resolved: DataFrame, now_ms: int) -> DataFrame:
    """Coordinator rows of transactions that were rolled back without an outcome; dated now, so they outlive this run."""
    orphans = resolved.where(F.col("action").isin(ROLLBACK_REMOVE, ROLLBACK_RESTORE) & F.col("c_state").isNull())
    return orphans.select("tx_id").distinct().select("tx_id", F.lit(ABORTED).alias("c_state"), F.lit(now_ms).cast("bigint").alias("tx_created_at"))


def finalized() -> Column:
    """Rows that a run has really resolved."""
    return ~F.col("action").isin(KEEP, SKIP)


def counts(resolved: DataFrame) -> DataFrame:
    """scanned and finalized, in one pass."""
    return resolved.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(finalized()).alias("finalized"))
