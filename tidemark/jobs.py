"""The jobs: finalize records, release locks, delete settled proofs and coordinator rows, reconcile.

Each job freezes its boundary before it looks for targets and keeps it in the store's pointer, so a rerun
works with the same one; of several writers that begin a run, one stores its boundary and the others take it
over. A target is published together with its mark of completion, and only if no other job has changed it
meanwhile; otherwise its work is done again on what is live now. Only files that hold selected rows are
written anew, and of a table laid out by age a deletion reads no more than the boundary's own bucket. Counts
are those of the run at hand.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import tokens
from tidemark.functions.times import lock_boundary
from tidemark.operators import locks as lock_ops
from tidemark.operators import recovery, retention, watermarks
from tidemark.operators.audit import unsafe_coordinator_deletes, unsafe_proof_deletes
from tidemark.operators.predicates import coordinator_deletable, guarded, needs_finalization, needs_release, proof_deletable
from tidemark.schemas import ABORTED, ATTEMPTS, COORDINATOR, DEFAULT_NAMESPACE, LEDGER, LOCKS, PROOFS, TRANSACTION_COLUMNS, WATERMARKS, TableSpec
from tidemark.sources import discovery
from tidemark.sources.shared import written
from tidemark.sources.snapshot import AGE, LostUpdate, Store

COORDINATOR_TABLE, PROOF_TABLE, REGISTRY_TABLE, WATERMARK_TABLE = "coordinator_state", "request_proof", "namespace", "watermarks"
LOCK_TABLE, ATTEMPT_TABLE = "asset_lock", "lock_attempts"
#: How often a target's work is done again when other jobs change its tables meanwhile.
TRIES = 5


class UnsafeDeletion(RuntimeError):
    """A row that is about to be deleted is still needed."""


@dataclass
class RunReport:
    """What a run did: its boundary, its token (None for deletions) and the counts of each target."""

    boundary_ms: int
    token: str | None = None
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, self.boundary_ms, c.get("scanned", 0), c.get("changed", 0)) for t, c in self.counts.items()]
        return spark.createDataFrame(rows, "target string, boundary_ms bigint, scanned bigint, changed bigint").withColumn("boundary", F.timestamp_millis("boundary_ms"))


def _now() -> int:
    return int(time.time() * 1000)


def _begin(store: Store, run: str, fresh: dict) -> dict:
    """The run's stored state; ``fresh`` is stored first if there is none, unless another writer is faster."""
    state = store.run(run)
    while state is None:
        try:
            store.publish({}, {run: fresh}, fresh_runs=True)
            return fresh
        except LostUpdate:
            state = store.run(run)
    return state


def _again(work: Callable[[], None]) -> None:
    """Do the work anew when another job has changed its tables."""
    for attempt in range(TRIES):
        try:
            return work()
        except LostUpdate:
            if attempt == TRIES - 1:
                raise


def _record(spark: SparkSession, store: Store, server: str, started_at_ms: int, domain: str) -> str:
    """Write the finished run's watermark, once; its token."""

    def work() -> None:
        row = spark.createDataFrame([(domain, server, started_at_ms)], WATERMARKS.schema)
        if not store.exists(WATERMARK_TABLE):
            return store.publish({WATERMARK_TABLE: store.stage(WATERMARK_TABLE, row)}, based_on={WATERMARK_TABLE: None})
        entry = store.entry(WATERMARK_TABLE)
        if store.read(WATERMARK_TABLE, entry=entry).join(row, list(WATERMARKS.struct().names), "left_semi").isEmpty():
            store.publish({WATERMARK_TABLE: store.appended(WATERMARK_TABLE, row, entry)}, based_on={WATERMARK_TABLE: entry})

    _again(work)
    return watermarks.token(spark, server, started_at_ms)


def _append(store: Store, table: str, rows: DataFrame) -> None:
    """Add rows to a table that may not be there yet."""

    def work() -> None:
        with store.lock:
            if not store.exists(table):
                return store.publish({table: store.stage(table, rows)}, based_on={table: None})
            entry = store.entry(table)
            store.publish({table: store.appended(table, rows, entry)}, based_on={table: entry})

    _again(work)


class StoredAttempts(lock_ops.Attempts):
    """The attempts of a run on the locks of one namespace, or of all where it is None, kept in the store."""

    def __init__(self, store: Store, run: str, namespace: str | None):
        self.store, self.run, self.namespace = store, run, namespace

    def known(self) -> DataFrame | None:
        if not self.store.exists(ATTEMPT_TABLE):
            return None
        rows = self.store.read(ATTEMPT_TABLE).where(F.col("run") == self.run).drop("run")
        return rows if self.namespace is None else rows.where(F.col("ns") == self.namespace)

    def add(self, told: DataFrame) -> None:
        _append(self.store, ATTEMPT_TABLE, told.withColumn("run", F.lit(self.run)).select(*ATTEMPTS.struct().names))


def ledger_tables(store: Store) -> list[str]:
    """Transactional tables of the store, the coordinator's own left out."""
    found = [t for t in store.tables() if t != COORDINATOR_TABLE and set(TRANSACTION_COLUMNS) <= set(store.read(t).columns)]
    return found


def catalog_targets(spark: SparkSession, coordinator: str, databases: list[str] | None = None) -> list[str]:
    """Qualified names of the transactional tables of the session's catalog, the coordinator's own left out."""
    found = discovery.targets(discovery.catalog_tables(spark, databases), coordinator)
    # one row for each table of the catalog
    return discovery.required([r[0] for r in found.select("full_name").orderBy("full_name").collect()])


def progress(spark: SparkSession, state: dict) -> DataFrame:
    """One row: completed of all targets."""
    rows = [(t, t in state["completed"]) for t in state["targets"]]
    return spark.createDataFrame(rows, "target string, completed boolean").agg(F.count(F.lit(1)).alias("targets"), F.count_if("completed").alias("completed"))


def _each_target(spark: SparkSession, state: dict, report: RunReport, work: Callable[[str], None], at_once: int) -> None:
    """All pending targets are tried, ``at_once`` of them together; the first failure is raised when all are done, and carries the rest.

    Under the fair scheduler targets share the cluster evenly, as each has a pool of its own.
    """

    def one(target: str) -> Exception | None:
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", target)
            return work(target)
        except Exception as error:  # noqa: BLE001
            return error

    pending = [t for t in state["targets"] if t not in state["completed"]]
    if at_once > 1:
        with ThreadPoolExecutor(at_once) as pool:
            found = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), t) for t in pending]]
    else:
        pool_before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        found = [one(t) for t in pending]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool_before)
    failed = {t: e for t, e in zip(pending, found) if e is not None}
    report.failures.update({t: str(e) for t, e in failed.items()})
    if failed:
        first, *others = failed
        for t in others:
            failed[first].add_note(f"{t}: {failed[t]}")
        raise failed[first]


def _completed(state: dict, target: str, resolved: dict | None = None) -> dict:
    """The run's state with one more mark; marks of others are kept when it is published."""
    return state | {"completed": [target]} | ({"resolved": {target: resolved}} if resolved else {})


def _scanned(store: Store, table: str, entry: list[dict]) -> int:
    """Rows of a table: from the frames of rows by file where it has them, else from the files' footers."""
    if all(s.get("age") for s in entry):
        return store.rows_of_files(table, entry).agg(F.sum("n")).first()[0] or 0
    return store.read(table, entry=entry).count()


def _unresolved(state: dict | None, target: str, entry: list[dict], spec: TableSpec) -> dict[str, Column]:
    """Where an earlier run has left something to do, by segment: from the age up that it has left undecided; new segments have none."""
    told = ((state or {}).get("resolved") or {}).get(target)
    if not told:
        return {}
    later, out = F.col(spec.age_col) >= told["from_ms"], {}
    for s in entry:
        if s["at"] in told["segments"]:
            out[s["at"]] = later & (F.col(AGE) >= told["from_ms"] // s["age"]["width"]) if s.get("age") else later
    return out


def finalize_records(
    spark: SparkSession, store: Store, now_ms: int | None = None, expiry_ms: int = recovery.EXPIRY_MS, spec: TableSpec = LEDGER, run: str = "ledger",
    recover_fn: recovery.Recovery | None = None, coordinator_spec: TableSpec = COORDINATOR, domain: str = DEFAULT_NAMESPACE, at_once: int = 1, after: str | None = None,
) -> RunReport:
    """Drive in-doubt records of every transactional table to a final state and emit the ledger's token.

    ``recover_fn`` gives the in-doubt records their action; the default joins them with the transactions'
    outcomes. ``at_once`` targets are worked on together. ``after`` names a finished earlier run: in segments that
    it has seen only records are looked for that it has left undecided or that were too new for it.
    """
    started = _now() if now_ms is None else now_ms
    state = store.run(run)
    if state is None:
        state = _begin(store, run, {"started_at_ms": started, "targets": discovery.required(ledger_tables(store)), "completed": []})
    boundary = state["started_at_ms"]
    report, chosen = RunReport(boundary), needs_finalization(boundary, spec.state_col, spec.age_col)
    earlier = store.run(after) if after else None

    def resolve(records: DataFrame, coordinator: DataFrame, boundary_ms: int, at_ms: int) -> DataFrame:
        return recovery.resolve(records, coordinator, boundary_ms, at_ms, expiry_ms, spec, thin=True)

    def with_aborts(told: DataFrame, seen: list[dict]) -> tuple[list[dict], list[dict]] | None:
        """The coordinator's segments now and with the new abort rows; None if there are none."""
        aborts = recovery.new_aborts(told, max(started, boundary))
        if aborts.isEmpty():
            return None
        entry = store.entry(COORDINATOR_TABLE)
        coordinator = store.read(COORDINATOR_TABLE, entry=entry)
        fresh = [s for s in entry if s not in seen]
        if fresh:  # outcomes that came since the records were judged
            came = coordinator_spec.named(store.read(COORDINATOR_TABLE, entry=fresh)).join(aborts.select("tx_id"), "tx_id", "left_semi")
            if not came.where(~F.col(coordinator_spec.state_col).eqNullSafe(ABORTED)).isEmpty():
                raise LostUpdate("an outcome came while records were judged")
            aborts = aborts.join(came.select("tx_id"), "tx_id", "left_anti")
        rows = coordinator_spec.coded(aborts).select(*coordinator_spec.struct().names)
        rows = rows.select([F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in coordinator.dtypes])
        return entry, store.appended(COORDINATOR_TABLE, rows, entry)

    def once(target: str) -> None:
        seen = {t: store.entry(t) for t in (target, COORDINATOR_TABLE)}
        spec.check(store.read(target, entry=seen[target]))
        coordinator = coordinator_spec.named(coordinator_spec.check(store.read(COORDINATOR_TABLE, entry=seen[COORDINATOR_TABLE])))
        told: list[DataFrame] = []

        def change(rows: DataFrame) -> DataFrame:
            told.append(written((recover_fn or resolve)(rows.where(chosen), coordinator, boundary, started), "finalize-resolved"))
            return spec.coded(rows.where(~chosen).unionByName(recovery.applied(told[0], spec)))

        narrow = _unresolved(earlier, target, seen[target], spec)
        fresh = store.revised(target, seen[target], chosen, change, spec.named, **({"narrow": narrow} if narrow else {}))
        changed, undecided = 0, None
        if fresh is not None:
            row = told[0].agg(F.count_if(recovery.finalized()).alias("n"), F.min(F.when(~recovery.finalized(), F.col(spec.age_col))).alias("from_ms")).first()
            changed, undecided = row["n"], row["from_ms"]
        left = {"from_ms": min(x for x in (boundary, undecided) if x is not None), "segments": [s["at"] for s in fresh or seen[target]]}
        with store.lock:  # targets that are worked on together add their abort rows one after the other
            changes, based_on = ({}, {}) if fresh is None else ({target: fresh}, {target: seen[target]})
            added = with_aborts(told[0], seen[COORDINATOR_TABLE]) if told else None
            if added:
                based_on[COORDINATOR_TABLE], changes[COORDINATOR_TABLE] = added
            store.publish(changes, {run: _completed(state, target, left)}, based_on=based_on)
        report.counts[target] = {"scanned": _scanned(store, target, seen[target]), "changed": changed}

    _each_target(spark, state, report, lambda target: _again(lambda: once(target)), at_once)
    report.token = _record(spark, store, tokens.LEDGER, boundary, domain)
    return report


def lock_namespaces(spark: SparkSession, store: Store) -> list[str]:
    registry = store.read(REGISTRY_TABLE) if store.exists(REGISTRY_TABLE) else None
    # one row per namespace of the ledger
    return [r[0] for r in discovery.namespaces(registry, spark).orderBy("ord", "name").collect()]


def lock_table(base: str, namespace: str) -> str:
    return f"{base if namespace == DEFAULT_NAMESPACE else f'{base}_{namespace}'}.{LOCK_TABLE}"


def all_locks(store: Store) -> DataFrame | None:
    """The lock tables of all namespaces as one relation, with the physical namespace in ns."""
    found = [t for t in store.tables() if t.endswith(f".{LOCK_TABLE}")]
    return lock_ops.union_namespaces({t.removesuffix(f".{LOCK_TABLE}"): store.read(t) for t in found}) if found else None


def finalize_locks(
    spark: SparkSession, store: Store, base: str, now_ms: int | None = None, recover_fn: lock_ops.Recovery = lock_ops.expired,
    wait_s: float = lock_ops.WAIT_S, run: str = "auditor", domain: str = DEFAULT_NAMESPACE, at_once: int = 1,
) -> RunReport:
    """Release stranded locks of every namespace and emit the auditor's token.

    Every attempt's outcomes are stored, so a run that was killed doesn't ask again for locks that were
    recovered. ``at_once`` namespaces are worked on together.
    """
    started = lock_boundary(_now() if now_ms is None else now_ms)
    state = store.run(run) or _begin(store, run, {"started_at_ms": started, "targets": lock_namespaces(spark, store), "completed": []})
    boundary = state["started_at_ms"]
    report = RunReport(boundary)

    def once(namespace: str) -> None:
        table = lock_table(base, namespace)
        entry, with_ns = store.entry(table), lambda df: df.withColumn("ns", F.lit(namespace))
        held = LOCKS.check(with_ns(store.read(table, entry=entry)))
        chosen, selected = lock_ops.candidates(held, boundary), needs_release(boundary)
        done = lock_ops.recover(chosen, recover_fn, wait_s=wait_s, log=StoredAttempts(store, run, namespace))
        fresh = store.revised(table, entry, selected, lambda rows: lock_ops.all_released(rows, selected).drop("ns"), with_ns)
        changes = {} if fresh is None else {table: fresh}
        store.publish(changes, {run: _completed(state, namespace)}, based_on={t: entry for t in changes})
        report.counts[namespace] = {"scanned": _scanned(store, table, entry), "changed": done.count()}

    _each_target(spark, state, report, lambda namespace: _again(lambda: once(namespace)), at_once)
    report.token = _record(spark, store, tokens.AUDITOR, boundary, domain)
    return report


def _delete(store: Store, run: str, table: str, spec: TableSpec, boundary: int, deletable, safe: Callable[[int], None] | None = None) -> RunReport:
    """Delete the selected rows; one that has no key fails the job.

    Of a table laid out by age whole buckets go unread. Of another table one pass finds the files that hold
    selected rows, a second one writes what stays of those. ``safe`` raises where the boundary isn't safe; it
    has been asked about ``boundary``.
    """
    state = store.run(run) or _begin(store, run, {"deletable_before_ms": boundary, "completed": False})
    report = RunReport(state["deletable_before_ms"])
    if state["completed"]:
        return report
    gone = deletable(state["deletable_before_ms"])
    # a guard counts only where its value is used, so each key itself is tested
    keyed = reduce(Column.__and__, [guarded(k, gone).isNotNull() for k in spec.keys])
    if safe is not None and report.boundary_ms != boundary:  # another writer has begun the run
        safe(report.boundary_ms)

    def once() -> None:
        entry = store.entry(table)
        spec.check(store.read(table, entry=entry))
        laid_out = all((s.get("age") or {}).get("column") == spec.age_col and s["age"]["keys"] == list(spec.keys) for s in entry)
        if laid_out:
            fresh, n = store.aged_out(table, entry, state["deletable_before_ms"], gone, keyed)
        else:
            seen = Observation()
            fresh = store.revised(table, entry, gone & keyed, lambda df: retention.survivors(df.observe(seen, F.count_if(gone).alias("n")), gone))
            n = 0 if fresh is None else seen.get["n"]
        changes = {} if fresh is None else {table: fresh}
        store.publish(changes, {run: state | {"completed": True}}, based_on={t: entry for t in changes})
        report.counts[table] = {"scanned": _scanned(store, table, entry), "changed": n}

    _again(once)
    return report


def cleanup_proofs(spark: SparkSession, store: Store, auditor_token: str | None = None, run: str = "proofs") -> RunReport:
    """Delete proofs registered before the auditor's boundary, once no write lock needs them.

    A resumed run keeps its own boundary.
    """
    known = store.run(run)
    boundary = known["deletable_before_ms"] if known else watermarks.read_token(spark, auditor_token, tokens.AUDITOR)

    def safe(boundary_ms: int) -> None:
        held = all_locks(store)
        needed = held and unsafe_proof_deletes(store.read(PROOF_TABLE), held, proof_deletable(boundary_ms), boundary_ms).first()
        if needed:
            raise UnsafeDeletion(f"proof {needed['nonce']} belongs to a write lock that is still held")

    if not (known and known["completed"]):
        safe(boundary)
    return _delete(store, run, PROOF_TABLE, PROOFS, boundary, proof_deletable, safe)


def finalize_auditor(spark: SparkSession, store: Store, base: str, now_ms: int | None = None, **options) -> RunReport:
    """Release locks, then delete proofs; the token is returned only if both succeed."""
    report = finalize_locks(spark, store, base, now_ms, **options)
    report.counts.update(cleanup_proofs(spark, store, report.token).counts)
    return report


def recorded_boundary(store: Store, domain: str = DEFAULT_NAMESPACE) -> int | None:
    """The boundary below which both servers' recorded runs make deletion safe; None if either is missing."""
    if not store.exists(WATERMARK_TABLE):
        return None
    row = watermarks.boundaries(store.read(WATERMARK_TABLE)).where(F.col("domain") == domain).first()
    return row["deletable_before_ms"] if row else None


def cleanup_coordinator(
    spark: SparkSession, store: Store, ledger_token: str | None = None, auditor_token: str | None = None, run: str = "coordinator",
    spec: TableSpec = LEDGER, domain: str = DEFAULT_NAMESPACE,
) -> RunReport:
    """Delete coordinator rows older than both boundaries, once no in-doubt record of any table needs them.

    Without tokens the boundary is that of the recorded watermarks.
    """
    known = store.run(run)
    boundary = known["deletable_before_ms"] if known else None
    if boundary is None and ledger_token is None and auditor_token is None:
        boundary = recorded_boundary(store, domain)
    if boundary is None:
        boundary = min(watermarks.read_token(spark, ledger_token, tokens.LEDGER), watermarks.read_token(spark, auditor_token, tokens.AUDITOR))

    def safe(boundary_ms: int) -> None:
        targets = ledger_tables(store)
        if not targets:
            return
        records = discovery.one_relation({t: spec.named(store.read(t)) for t in targets}, *TRANSACTION_COLUMNS)
        needed = unsafe_coordinator_deletes(store.read(COORDINATOR_TABLE), records, coordinator_deletable(boundary_ms), boundary_ms, thin=True).first()
        if needed:
            names = records.where(needs_finalization(boundary_ms) & (F.col("tx_id") == needed["tx_id"])).select("full_name").distinct().limit(1).first()
            raise UnsafeDeletion(f"{names[0]} has in-doubt records older than the boundary")

    if not (known and known["completed"]):
        safe(boundary)
    return _delete(store, run, COORDINATOR_TABLE, COORDINATOR, boundary, coordinator_deletable, safe)
