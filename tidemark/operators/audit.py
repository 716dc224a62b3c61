"""Invariants that make deletion safe, as queries that must return no rows, and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import needs_finalization
from tidemark.operators.prefilter import matching
from tidemark.schemas import LOCK_WRITE


def unsafe_coordinator_deletes(coordinator: DataFrame, records: DataFrame, deletable: Column, boundary_ms: int, thin: bool = False) -> DataFrame:
    """Deletable coordinator rows that an in-doubt record still needs.

    ``thin`` counts the in-doubt records first; where they are few, as after a finalization, the coordinator table isn't shuffled.
    """
    gone, waiting = coordinator.where(deletable), records.where(needs_finalization(boundary_ms)).select("tx_id")
    return matching(gone, waiting, "tx_id") if thin else gone.join(waiting, "tx_id", "left_semi")


def unsafe_proof_deletes(proofs: DataFrame, locks: DataFrame, deletable: Column, boundary_ms: int) -> DataFrame:
    """Deletable proofs whose transaction still holds a write lock that is no later than the proof."""
    held = locks.where((F.col("lock_type") == LOCK_WRITE) & (F.col("last_updated_at") < boundary_ms)).select(F.explode("owner_nonces").alias("nonce"), "last_updated_at")
    held = held.groupBy("nonce").agg(F.min("last_updated_at").alias("_earliest"))
    gone = proofs.where(deletable).join(held, "nonce")
    return gone.where(F.col("_earliest") <= F.col("registered_at")).select(*proofs.columns)


def reconciled(named: dict[str, tuple[DataFrame, DataFrame, Column]]) -> DataFrame:
    """Per table: rows before, rows after, rows selected for deletion, and whether they agree."""
    out = None
    for name, (before, after, deletable) in named.items():
        a = before.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(deletable).alias("n_deleted"))
        row = a.crossJoin(after.agg(F.count(F.lit(1)).alias("n_after"))).select(F.lit(name).alias("tbl"), "n_before", "n_after", "n_deleted")  # one row each
        out = row if out is None else out.unionByName(row)
    return out.withColumn("agrees", F.col("n_before") - F.col("n_after") == F.col("n_deleted"))


def reconciled_safely(named: dict[str, tuple[DataFrame, DataFrame, Column, DataFrame]]) -> DataFrame:
    """As :func:`reconciled`, with the number of deleted rows that are still needed (the fourth frame) in n_unsafe."""
    unsafe = None
    for name, (*_, needed) in named.items():
        row = needed.agg(F.count(F.lit(1)).alias("n_unsafe")).select(F.lit(name).alias("tbl"), "n_unsafe")
        unsafe = row if unsafe is None else unsafe.unionByName(row)
    return reconciled({name: three for name, (*three, _) in named.items()}).join(unsafe, "tbl")


def covered(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of two runs of a scan, those that were delivered twice once."""
    return first.unionByName(second).dropDuplicates([key])


class Unreconciled(RuntimeError):
    """What a table has isn't what should be left of it."""


def _row_hash(columns: list[str], salt: int) -> Column:
    """A row's hash; a null differs from any value, and a value from the same one in another column."""
    marked = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(salt), *marked).cast("decimal(20,0)")


def content(df: DataFrame, kept: Column | None = None) -> DataFrame:
    """One row: n_rows, n_kept, and the digest of the kept rows, which doesn't depend on their order.

    The digest is two sums of 64-bit hashes over all columns, in order of their names, formed in the same
    pass as the counts. A changed, missing, additional or repeated row changes it.
    """
    kept = F.lit(True) if kept is None else kept
    columns = sorted(df.columns)
    sums = [F.coalesce(F.sum(F.when(kept, _row_hash(columns, salt))), F.lit(0)).cast("decimal(38,0)").cast("string") for salt in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(kept).alias("n_kept"), F.concat_ws(":", *sums).alias("digest"))


def reconciled_content(named: dict[str, tuple[DataFrame, DataFrame, Column]]) -> DataFrame:
    """Per table (before, after, deletable): its counts, whether they agree, and whether the survivors are what they were."""
    parts = []
    for name, (before, after, deletable) in named.items():
        for side, df, kept in (("before", before, ~deletable), ("after", after, None)):
            parts.append(content(df, kept).select(F.lit(name).alias("tbl"), F.lit(side).alias("side"), "n_rows", "n_kept", "digest"))
    of = lambda side, column: F.max(F.when(F.col("side") == side, F.col(column)))
    out = reduce(DataFrame.unionByName, parts).groupBy("tbl").agg(
        of("before", "n_rows").alias("n_before"), of("after", "n_rows").alias("n_after"), (of("before", "n_rows") - of("before", "n_kept")).alias("n_deleted"),
        (of("before", "n_kept") == of("after", "n_rows")).alias("agrees"), (of("before", "digest") == of("after", "digest")).alias("same_content"),
    )
    return out


def reconcile(named: dict[str, tuple[DataFrame, DataFrame, Column]]) -> DataFrame:
    """:func:`reconciled_content`, or an error that names a table whose counts or survivors differ."""
    found = reconciled_content(named)
    wrong = found.where(~(F.col("agrees") & F.col("same_content"))).first()
    if wrong:
        what = "rows are missing or too many" if not wrong["agrees"] else "a surviving row has changed"
        raise Unreconciled(f"{wrong['tbl']}: {what} ({wrong['n_before']} before, {wrong['n_deleted']} deleted, {wrong['n_after']} after)")
    return found
