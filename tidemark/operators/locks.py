"""Releasing stranded locks of all namespaces as one relation, with a recovery that may need several tries."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.predicates import guarded, needs_release
from tidemark.schemas import LOCK_NONE
from tidemark.sources.shared import written

SUCCEEDED, NOT_NEEDED, FAILED, NOT_RECOVERABLE = "SUCCEEDED", "NOT_NEEDED", "FAILED", "NOT_RECOVERABLE"
ATTEMPTS, WAIT_S = 3, 15
#: (locks, attempt) to the same keys with an outcome.
Recovery = Callable[[DataFrame, int], DataFrame]


class RecoveryFailed(RuntimeError):
    """A lock couldn't be recovered."""


def union_namespaces(tables: dict[str, DataFrame]) -> DataFrame:
    """Lock tables of logical namespaces as one relation with the logical name in ns."""
    return reduce(DataFrame.unionByName, [df.withColumn("ns", F.lit(ns)) for ns, df in tables.items()])


def candidates(locks: DataFrame, boundary_ms: int) -> DataFrame:
    """Locks to release. The guards are computed before anything is filtered."""
    checked = locks.withColumn("_release", needs_release(boundary_ms))
    return checked.withColumn("id", guarded("id", F.col("_release"))).where("_release").drop("_release")


def expired(locks: DataFrame, attempt: int) -> DataFrame:
    """The default recovery: a selected lock has no living holder."""
    return locks.select("ns", "id").withColumn("outcome", F.lit(SUCCEEDED))


class Attempts:
    """What each lock's recovery was last told, kept for the run of one process.

    Frames have ns, id, outcome, attempt and due_ms, the time from which on a further attempt may be made.
    """

    def __init__(self) -> None:
        self.frame: DataFrame | None = None

    def known(self) -> DataFrame | None:
        return self.frame

    def add(self, told: DataFrame) -> None:
        self.frame = told if self.frame is None else self.frame.unionByName(told)


def _latest(known: DataFrame | None, locks: DataFrame) -> DataFrame:
    """The locks with their last attempt and its outcome; attempt zero where there was none."""
    if known is None:
        return locks.select("ns", "id").withColumns({"attempt": F.lit(0), "outcome": F.lit(None).cast("string"), "due_ms": F.lit(0).cast("long")})
    last = known.groupBy("ns", "id").agg(F.max(F.struct("attempt", "outcome", "due_ms")).alias("last"))
    found = locks.select("ns", "id").join(last, ["ns", "id"], "left")
    return found.select("ns", "id", F.coalesce("last.attempt", F.lit(0)).alias("attempt"), "last.outcome", F.coalesce("last.due_ms", F.lit(0)).alias("due_ms"))


def recover(locks: DataFrame, recovery: Recovery = expired, attempts: int = ATTEMPTS, wait_s: float = WAIT_S, log: Attempts | None = None) -> DataFrame:
    """(ns, id, outcome, attempt) of every lock, asked again up to ``attempts`` times while it isn't recoverable.

    Each round works on what remains, and what it was told is written before the next one begins; with a ``log``
    in a store a run that was killed goes on with the attempt that is due and asks for no lock again whose
    outcome is stored (a round that was killed before its outcomes were stored is made again). A failed or
    unknown outcome ends the job at once, and so do locks that remain after the last round.
    """
    log, last = log or Attempts(), -1
    while True:
        latest = written(_latest(log.known(), locks), "lock-attempts")
        locks = latest.select("ns", "id")
        good = F.coalesce(F.col("outcome").isin(SUCCEEDED, NOT_NEEDED), F.lit(False))
        remaining = latest.where(~good)
        rounds = {r["attempt"]: r for r in remaining.groupBy("attempt").agg(F.max("due_ms").alias("due"), F.count(F.lit(1)).alias("n")).collect()}
        if not rounds:
            return latest.select("ns", "id", "outcome", "attempt")
        at = min(rounds)  # locks that came later may be some rounds behind
        if at <= last:
            raise RecoveryFailed(f"outcomes of attempt {at + 1} aren't in the log")
        last = at
        if at >= attempts:
            left = remaining.first()
            raise RecoveryFailed(f"lock {left['ns']}/{left['id']} isn't recoverable after {attempts} attempts")
        time.sleep(max(0.0, rounds[at]["due"] / 1000 - time.time()))
        asked = remaining.where(F.col("attempt") == at).select("ns", "id")
        told = asked.join(recovery(asked, at + 1), ["ns", "id"], "left").select("ns", "id", "outcome", F.lit(at + 1).alias("attempt"))
        told = written(told, "lock-outcomes")
        known = F.coalesce(F.col("outcome").isin(SUCCEEDED, NOT_NEEDED, NOT_RECOVERABLE), F.lit(False))
        bad = F.min(F.when(~known, F.struct("ns", "id", "outcome"))).alias("bad")
        n, left, bad = told.agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("left"), bad).first()
        log.add(told.where(known).withColumn("due_ms", F.lit(int((time.time() + wait_s) * 1000)).cast("long")))
        if bad:
            raise RecoveryFailed(f"lock {bad['ns']}/{bad['id']}: {bad['outcome']}")
        if not left and list(rounds) == [at] and n == rounds[at]["n"]:  # all that remained were asked and told once, so the log needn't be read again
            return latest.where(good).select("ns", "id", "outcome", "attempt").unionByName(told)


def all_released(locks: DataFrame, selected: Column) -> DataFrame:
    """The locks, of type NONE where they were selected: for a recovery that has ended well, as then every selected lock is released."""
    return locks.withColumn("lock_type", F.when(selected, LOCK_NONE).otherwise(F.col("lock_type")))


def released(locks: DataFrame, done: DataFrame) -> DataFrame:
    """The locks, of type NONE where they were released."""
    marks = done.select("ns", "id", F.lit(True).alias("_done"))
    return locks.join(marks, ["ns", "id"], "left").withColumn("lock_type", F.when(F.col("_done"), LOCK_NONE).otherwise(F.col("lock_type"))).select(*locks.columns)


def counts_by_namespace(locks: DataFrame, selected: Column) -> DataFrame:
    return locks.groupBy("ns").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(selected).alias("selected"))
