"""What the jobs don't do twice: reading schemas, asking the log again, joining locks that are all released."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import locks
from tidemark.operators.audit import unsafe_coordinator_deletes
from tidemark.operators.predicates import coordinator_deletable
from tidemark.schemas import LOCK_VALID_MS
from tidemark.sources.snapshot import Store


@pytest.fixture
def store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="spark-") + "/store")


def test_a_segments_schema_is_looked_up_once(spark, store):
    store.publish({"t": store.stage("t", spark.range(10).selectExpr("id", "cast(id AS string) AS name"))})
    first, group = store.read("t"), "schema-again"
    spark.sparkContext.setJobGroup(group, "the second look")
    try:
        again = store.read("t")
        assert again.schema == first.schema and not list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert again.count() == 10


def test_a_log_is_read_again_only_if_locks_remain(spark):
    class Counted(locks.Attempts):
        reads = 0

        def known(self):
            self.reads += 1
            return super().known()

    held = spark.createDataFrame([("ns", f"l{i}") for i in range(4)], "ns string, id string")
    log = Counted()
    done = locks.recover(held, wait_s=0, log=log)
    assert {(r.id, r.outcome, r.attempt) for r in done.collect()} == {(f"l{i}", locks.SUCCEEDED, 1) for i in range(4)} and log.reads == 1
    later = Counted()
    outcome = lambda rows, n: rows.withColumn("outcome", F.when(F.substring("id", 2, 1).cast("int") < n, locks.SUCCEEDED).otherwise(locks.NOT_RECOVERABLE))
    done = locks.recover(held.where("id < 'l3'"), outcome, wait_s=0, log=later)
    assert sorted((r.id, r.attempt) for r in done.collect()) == [("l0", 1), ("l1", 2), ("l2", 3)] and later.reads == 3


def test_locks_with_the_same_id_are_released_and_stay_as_many(spark, store):
    rows = [("a", 2, 5, ["n"]), ("a", 2, 6, ["m"]), ("b", 3, 5, ["o"]), ("c", 3, 90_000, ["p"]), ("d", 1, 5, ["q"])]
    frame = spark.createDataFrame(rows, "id string, lock_type int, last_updated_at long, owner_nonces array<string>")
    store.publish({"aud.asset_lock": store.stage("aud.asset_lock", frame)})
    report = jobs.finalize_locks(spark, store, "aud", 50_000 + LOCK_VALID_MS, wait_s=0)
    assert report.counts["default"] == {"scanned": 5, "changed": 3}
    left = sorted((r.id, r.lock_type, r.last_updated_at) for r in store.read("aud.asset_lock").collect())
    assert left == [("a", 1, 5), ("a", 1, 6), ("b", 1, 5), ("c", 3, 90_000), ("d", 1, 5)]


def test_unsafe_coordinator_rows_are_the_same_thinned_out(spark):
    coordinator = spark.createDataFrame([("t1", "COMMITTED", 5), ("t2", "ABORTED", 5), ("t3", "ABORTED", 50), (None, "ABORTED", 5)], "tx_id string, c_state string, tx_created_at long")
    records = spark.createDataFrame([("t1", "PREPARED", 5), ("t1", "DELETED", 6), ("t3", "PREPARED", 5), (None, "PREPARED", 5), ("t2", "COMMITTED", 5)], "tx_id string, tx_state string, tx_prepared_at long")
    for thin in (False, True):
        assert [r.tx_id for r in unsafe_coordinator_deletes(coordinator, records, coordinator_deletable(10), 10, thin=thin).collect()] == ["t1"]
