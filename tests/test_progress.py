"""Progress that survives failures: slices, attempts, targets at the same time, runs that follow runs; and digests of content."""

import glob
import os
import shutil
import tempfile
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import audit, locks, prefilter
from tidemark.operators.predicates import proof_deletable
from tidemark.schemas import COORDINATOR, TableSpec
from tidemark.sources.snapshot import DAY_MS, Store
from tidemark.streaming import scan

SCAN = TableSpec("t", "pk string, ck int", ("pk", "ck"), "ck")
RECORDS = "pk string, tx_id string, tx_state string, tx_prepared_at long, val double, before_val double"


@pytest.fixture
def store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="spark-") + "/store")


@pytest.fixture
def table(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(f"p{i % 5}", i) for i in range(600)], SCAN.schema).repartition(12).write.parquet(f"{path}/t")
    return path


def test_a_failed_slice_stops_no_other_and_repeats_its_own_tail_only(spark, table):
    calls, write, broken = [], scan.write_batch(f"{table}/out"), []

    def handler(batch, number):
        calls.append(number)
        if number % 4 == broken_slice and number >= 4 and not broken:
            broken.append(number)
            raise RuntimeError("stopped")
        write(batch, number)

    run = lambda: scan.sliced_scan(spark, f"{table}/t", SCAN, handler, f"{table}/run", slices=4, files_per_batch=1)
    listing = scan._listing(spark, f"{table}/t", f"{table}/run", 4, 1)
    pages = {r["slice"]: r["n"] for r in listing.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(pages.values()) == 12
    broken_slice = max(pages, key=pages.get)
    with pytest.raises(Exception, match="stopped"):
        run()
    done = set(calls) - set(broken)
    assert {n for n in done if n % 4 != broken_slice} == {k + 4 * i for k, n in pages.items() if k != broken_slice for i in range(n)}
    assert {n for n in done if n % 4 == broken_slice} == {broken_slice}  # its first page
    calls.clear()
    again = run()
    assert sorted(calls) == [broken_slice + 4 * i for i in range(1, pages[broken_slice])]
    assert again.slices == {k: again.rows if k == broken_slice else 0 for k in pages}
    rows = spark.read.parquet(f"{table}/out")
    assert rows.count() == 600 and rows.select("ck").distinct().count() == 600


def test_a_scan_keeps_its_listing_and_a_lost_slice_position_repeats_that_slice(spark, table):
    write = scan.write_batch(f"{table}/out")
    first = scan.sliced_scan(spark, f"{table}/t", SCAN, write, f"{table}/run", slices=3, files_per_batch=2)
    assert first.rows == 600 and sum(first.slices.values()) == 600
    spark.createDataFrame([("late", 1000)], SCAN.schema).write.mode("append").parquet(f"{table}/t")
    lost = max(first.slices, key=first.slices.get)
    shutil.rmtree(f"{table}/run/slice-{lost}")
    again = scan.sliced_scan(spark, f"{table}/t", SCAN, write, f"{table}/run", slices=3, files_per_batch=2)
    assert again.slices == {k: n if k == lost else 0 for k, n in first.slices.items()}
    assert scan.latest(spark.read.parquet(f"{table}/out"), ("ck",)).count() == 600


def test_a_corrupt_slice_position_fails_and_an_empty_table_delivers_nothing(spark, table):
    write = scan.write_batch(f"{table}/out")
    scan.sliced_scan(spark, f"{table}/t", SCAN, write, f"{table}/run", slices=2)
    for file in glob.glob(f"{table}/run/slice-0/offsets/[0-9]*"):
        with open(file, "w") as f:
            f.write("not a position")
    for file in glob.glob(f"{table}/run/slice-0/offsets/.*.crc"):
        open(file, "w").close()
    with pytest.raises(Exception):
        scan.sliced_scan(spark, f"{table}/t", SCAN, write, f"{table}/run", slices=2)
    os.makedirs(f"{table}/none")
    assert scan.sliced_scan(spark, f"{table}/none", SCAN, write, f"{table}/run2").rows == 0


def test_a_killed_job_goes_on_with_the_second_attempt(spark, store):
    held = spark.createDataFrame([("ns", f"l{i}") for i in range(6)], "ns string, id string")
    asked = []

    def recovery(rows, attempt):
        asked.append((attempt, sorted(r.id for r in rows.collect())))
        return rows.withColumn("outcome", F.when(F.substring("id", 2, 5).cast("int") % 2 < attempt, locks.SUCCEEDED).otherwise(locks.NOT_RECOVERABLE))

    def killed(rows, attempt):
        if attempt == 2:
            raise KeyboardInterrupt
        return recovery(rows, attempt)

    with pytest.raises(KeyboardInterrupt):
        locks.recover(held, killed, wait_s=0, log=jobs.StoredAttempts(store, "run", "ns"))
    done = locks.recover(held, recovery, wait_s=0, log=jobs.StoredAttempts(Store(spark, store.root), "run", "ns"))
    assert asked == [(1, [f"l{i}" for i in range(6)]), (2, ["l1", "l3", "l5"])]
    assert {(r.id, r.attempt) for r in done.collect()} == {(f"l{i}", 1 + i % 2) for i in range(6)}
    assert locks.recover(held, recovery, wait_s=0, log=jobs.StoredAttempts(store, "run", "ns")).count() == 6 and len(asked) == 2
    other = locks.recover(held, recovery, wait_s=0, log=jobs.StoredAttempts(store, "other", "ns"))
    assert other.count() == 6 and len(asked) == 4  # attempts belong to a run
    with pytest.raises(locks.RecoveryFailed, match="aren't in the log"):
        locks.recover(held, recovery, wait_s=0, log=jobs.StoredAttempts(store, "run", "another"))


def test_the_wait_for_an_attempt_survives_a_restart(spark, store):
    held = spark.createDataFrame([("ns", "l")], "ns string, id string")
    log = jobs.StoredAttempts(store, "run", "ns")
    log.add(held.withColumns({"outcome": F.lit(locks.NOT_RECOVERABLE), "attempt": F.lit(1), "due_ms": F.lit(int(time.time() * 1000) + 4000).cast("long")}))
    began = time.time()
    done = locks.recover(held, locks.expired, wait_s=0, log=log)
    assert time.time() - began > 2.5 and done.first().attempt == 2
    log.add(held.withColumns({"id": F.lit("m"), "outcome": F.lit(locks.NOT_RECOVERABLE), "attempt": F.lit(3), "due_ms": F.lit(0).cast("long")}))
    with pytest.raises(locks.RecoveryFailed, match="after 3 attempts"):
        locks.recover(held.withColumn("id", F.lit("m")), locks.expired, wait_s=0, log=log)


def test_outcomes_of_a_round_with_a_failure_are_stored(spark, store):
    held = spark.createDataFrame([("ns", "good"), ("ns", "bad")], "ns string, id string")
    log = jobs.StoredAttempts(store, "run", "ns")
    with pytest.raises(locks.RecoveryFailed, match="bad: FAILED"):
        locks.recover(held, lambda rows, _: rows.withColumn("outcome", F.when(F.col("id") == "good", locks.SUCCEEDED).otherwise(locks.FAILED)), wait_s=0, log=log)
    assert [(r.id, r.outcome) for r in log.known().collect()] == [("good", locks.SUCCEEDED)]


def test_a_changed_survivor_is_found_out(spark):
    rows = [("a", 1, [1.5, None]), ("b", 2, []), ("c", 3, None), ("c", 3, None), (None, 9, [0.0])]
    before = spark.createDataFrame(rows, "nonce string, registered_at long, more array<double>")
    gone = proof_deletable(2)
    after = before.where(~gone).repartition(3)
    assert audit.reconcile({"t": (before, after, gone)}).first().same_content
    others = {
        "value": [("b", 2, []), ("c", 3, None), ("c", 4, None), (None, 9, [0.0])], "null moved": [("b", 2, []), ("c", 3, None), ("c", 3, None), ("9", None, [0.0])],
        "swapped": [("b", 3, []), ("c", 2, None), ("c", 3, None), (None, 9, [0.0])], "repeated": [("b", 2, []), ("b", 2, []), ("c", 3, None), (None, 9, [0.0])],
    }
    for name, wrong in others.items():
        with pytest.raises(audit.Unreconciled, match="t: a surviving row has changed"):
            audit.reconcile({"t": (before, spark.createDataFrame(wrong, before.schema), gone)})
        assert name
    with pytest.raises(audit.Unreconciled, match="missing or too many"):
        audit.reconcile({"t": (before, after.limit(3), gone)})
    none = before.limit(0)
    assert audit.reconcile({"t": (none, none, gone)}).first().n_before == 0


def stored_records(spark, store, tables, n=6):
    frames = {t: spark.createDataFrame([(f"{t}{i}", f"tx{i}", "PREPARED", 1000 + i, 2.0, 1.0) for i in range(n)], RECORDS) for t in tables}
    frames["coordinator_state"] = spark.createDataFrame([("tx0", "COMMITTED", 1)], COORDINATOR.schema)
    store.publish({t: store.stage(t, df) for t, df in frames.items()})


def test_targets_are_worked_on_together_and_abort_a_transaction_once(spark, store):
    """The tables hold records of the same transactions, so each would write the same abort rows."""
    stored_records(spark, store, "abc")
    together, seen = threading.Barrier(3, timeout=60), []

    def resolve(rows, coordinator, boundary, now):
        seen.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        together.wait()  # nobody gets on before all have begun
        return jobs.recovery.resolve(rows, coordinator, boundary, now)

    report = jobs.finalize_records(spark, store, 1_000_000, recover_fn=resolve, at_once=3)
    assert sorted(seen) == ["a", "b", "c"] and {c["changed"] for c in report.counts.values()} == {6}
    aborted = store.read("coordinator_state").where("c_state = 'ABORTED'")
    assert sorted(r.tx_id for r in aborted.collect()) == [f"tx{i}" for i in range(1, 6)]
    assert store.run("ledger")["completed"] == ["a", "b", "c"]


def test_failures_of_targets_that_run_together_are_gathered(spark, store):
    stored_records(spark, store, "abc")

    def resolve(rows, coordinator, boundary, now):
        name = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        if name != "b":
            raise ValueError(f"{name} is broken")
        return jobs.recovery.resolve(rows, coordinator, boundary, now)

    with pytest.raises(ValueError, match="a is broken") as caught:
        jobs.finalize_records(spark, store, 1_000_000, recover_fn=resolve, at_once=3)
    assert caught.value.__notes__ == ["c: c is broken"] and store.run("ledger")["completed"] == ["b"]
    assert list(jobs.finalize_records(spark, store, 1_000_000).counts) == ["a", "c"]


@pytest.mark.parametrize("by_age", [False, True])
def test_a_second_run_looks_at_what_the_first_has_left(spark, store, by_age):
    """Old segments' rows below the first boundary are planted as in doubt again: a run that looked at them would change them."""
    now, frames = 9 * DAY_MS, {}
    for t in "ab":
        rows = [(f"{t}{i}", f"{t}tx{i}", "PREPARED", i * DAY_MS, 2.0, 1.0) for i in range(8)] + [(f"{t}s", f"{t}s", "PREPARED", now - 5000, 2.0, 1.0), (f"{t}n", f"{t}n", "PREPARED", now + 7, 2.0, 1.0)]
        df = spark.createDataFrame(rows, RECORDS)
        frames[t] = store.laid_out(t, df, "tx_prepared_at", ("pk",)) if by_age else store.stage(t, df)
    frames["coordinator_state"] = store.stage("coordinator_state", spark.createDataFrame([], COORDINATOR.schema))
    store.publish(frames)
    first = jobs.finalize_records(spark, store, now, run="first")
    assert first.counts["a"]["changed"] == 8
    told = store.run("first")["resolved"]["a"]
    assert told["from_ms"] == now - 5000 and told["segments"] == [s["at"] for s in store.entry("a")]
    entry = store.entry("a")
    narrow = jobs._unresolved(store.run("first"), "a", entry, jobs.LEDGER)
    looked = store._segment("a", entry[0]).where(narrow[entry[0]["at"]])
    plan = looked._jdf.queryExecution().toString()
    assert ("PartitionFilters: [isnotnull(_age" in plan) == by_age and "GreaterThanOrEqual(tx_prepared_at" in plan
    late = spark.createDataFrame([("al", "al", "PREPARED", 5, 2.0, 1.0)], RECORDS)
    store.publish({"a": store.appended("a", late, entry)})
    second = jobs.finalize_records(spark, store, now + 40_000, run="second", after="first")
    assert second.counts["a"]["changed"] == 3 and second.counts["b"]["changed"] == 2
    assert all(store.read(t).where("tx_state <> 'COMMITTED' OR val <> 1.0").isEmpty() for t in "ab")


def test_many_candidates_meet_a_bloom_filter_in_the_scan(spark, monkeypatch, tmp_path):
    spark.range(40_000).selectExpr("concat('tx', id) AS tx_id", "'ABORTED' AS c_state", "id AS tx_created_at").write.parquet(f"{tmp_path}/c")
    spark.range(0, 80_000, 97).selectExpr("IF(id % 5 = 0, NULL, concat('tx', id)) AS tx_id").write.parquet(f"{tmp_path}/k")
    rows, keys = spark.read.parquet(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/k")
    want = sorted(r.tx_id for r in prefilter.matching(rows, keys, "tx_id").collect())
    assert want == sorted(f"tx{i}" for i in range(0, 40_000, 97) if i % 5)
    monkeypatch.setattr(prefilter, "BROADCAST_KEYS", 10)
    before = spark.conf.get(prefilter.SETTINGS + "applicationSideScanSizeThreshold")
    assert sorted(r.tx_id for r in prefilter.matching(rows, keys, "tx_id").collect()) == want
    assert spark.conf.get(prefilter.SETTINGS + "applicationSideScanSizeThreshold") == before
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with prefilter.bloom_filters(spark, 1000):
            joined = prefilter.shuffled(rows, keys, "tx_id", "tx0")
            assert "might_contain" in joined._jdf.queryExecution().optimizedPlan().toString()
            passed = spark.sql("SELECT 1").count() and joined.count()
        assert passed == len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert prefilter.matching(rows, keys.limit(0), "tx_id").count() == 0
