"""Whole jobs over small stores: results, resumption after failures, and the order that keeps deletion safe."""

import glob
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import locks, recovery
from tidemark.schemas import COORDINATOR, LEDGER, TableSpec
from tidemark.sources import shared
from tidemark.sources.discovery import TooFewTargets
from tidemark.sources.documents import typed
from tidemark.sources.snapshot import CorruptState, LostUpdate, Store
from tidemark.streaming import scan

NOW, OLD = 1_000_000, 10_000
RECORDS = "pk string, tx_id string, tx_state string, tx_prepared_at long, val double, before_val double"
STATES = [("COMMITTED", None, "COMMITTED"), ("PREPARED", None, None), ("DELETED", 5.0, None), ("PREPARED", 5.0, "COMMITTED"), ("DELETED", 5.0, "COMMITTED")]


def records(spark, name):
    return spark.createDataFrame([(f"{name}{i}", f"{name}-tx{i}", STATES[i % 5][0], OLD, 9.0, STATES[i % 5][1]) for i in range(10)], RECORDS)


@pytest.fixture
def store(spark):
    s = Store(spark, tempfile.mkdtemp(prefix="spark-") + "/store")
    states = [(f"{n}-tx{i}", STATES[i % 5][2], OLD) for n in "ab" for i in range(10) if STATES[i % 5][2]]
    frames = {
        "a": records(spark, "a"), "b": records(spark, "b"), "empty": records(spark, "e").limit(0),
        "coordinator_state": spark.createDataFrame([*states, ("null", "COMMITTED", None), ("new", "ABORTED", NOW + 1)], "tx_id string, c_state string, tx_created_at long"),
        "request_proof": spark.createDataFrame([("old", OLD), ("edge", NOW - 15_000), ("new", NOW), ("null", None)], "nonce string, registered_at long"),
        "namespace": spark.createDataFrame([(0, "ns1"), (0, "default"), (1, "other")], "partition_id int, name string"),
    }
    for name in ("aud.asset_lock", "aud_ns1.asset_lock"):
        rows = [(f"asset-{i}", (1, 3, 2, 3)[i % 4], 2**53 if i % 4 == 3 else 1, [f"n{i}"]) for i in range(8)]
        frames[name] = spark.createDataFrame(rows, "id string, lock_type int, last_updated_at long, owner_nonces array<string>")
    s.publish({n: s.stage(n, df) for n, df in frames.items()})
    return s


def test_a_whole_cycle(spark, store):
    ledger = jobs.finalize_records(spark, store, NOW)
    assert ledger.counts["a"] == {"scanned": 10, "changed": 8} and ledger.counts["empty"] == {"scanned": 0, "changed": 0}
    for name in "ab":
        left = {r.pk: (r.tx_state, r.val) for r in store.read(name).collect()}
        assert left == {f"{name}{i}": ("COMMITTED", 5.0 if i % 5 == 2 else 9.0) for i in range(10) if i % 5 in (0, 2, 3)}
    assert store.read("coordinator_state").where("c_state = 'ABORTED' AND tx_created_at = 1000000").count() == 8
    auditor = jobs.finalize_auditor(spark, store, "aud", NOW, wait_s=0)
    assert auditor.boundary_ms == NOW - 15_000
    assert auditor.counts["ns1"] == {"scanned": 8, "changed": 4} and auditor.counts["request_proof"] == {"scanned": 4, "changed": 1}
    assert {r.lock_type for r in store.read("aud_ns1.asset_lock").where("id IN ('asset-1', 'asset-2')").collect()} == {1}
    assert store.read("aud.asset_lock").where("lock_type = 3").count() == 2
    before = store.read("coordinator_state").count()
    gone = jobs.cleanup_coordinator(spark, store, ledger.token, auditor.token)
    assert gone.boundary_ms == NOW - 15_000
    assert before - store.read("coordinator_state").count() == gone.counts["coordinator_state"]["changed"] == 12
    again = jobs.cleanup_coordinator(spark, store, "ignored", None)
    assert again.boundary_ms == gone.boundary_ms and again.counts == {}
    assert jobs.finalize_records(spark, store, NOW + 5).token == ledger.token
    assert ledger.frame(spark).count() == 3


def test_deletion_waits_for_finalization(spark, store):
    token = lambda kind: jobs.watermarks.token(spark, kind, NOW)
    with pytest.raises(jobs.UnsafeDeletion):
        jobs.cleanup_coordinator(spark, store, token("ledger"), token("auditor"))


def test_failed_target_is_taken_up_again(spark, store):
    store.publish({"b": store.stage("b", spark.createDataFrame([("x", "t", "PREPARED", 1)], "pk string, tx_id string, tx_state string, tx_prepared_at long"))})
    with pytest.raises(ValueError, match="no column val"):
        jobs.finalize_records(spark, store, NOW)
    assert store.run("ledger")["completed"] == ["a", "empty"]
    assert jobs.progress(spark, store.run("ledger")).first().completed == 2
    store.publish({"b": store.stage("b", records(spark, "b"))})
    report = jobs.finalize_records(spark, store, NOW + 99)
    assert list(report.counts) == ["b"] and report.boundary_ms == NOW and report.token


def test_locks_that_fail_leave_no_token(spark, store):
    with pytest.raises(locks.RecoveryFailed):
        jobs.finalize_auditor(spark, store, "aud", NOW, wait_s=0, recover_fn=lambda df, _: df.withColumn("outcome", F.lit("FAILED")))
    assert store.run("proofs") is None and store.read("request_proof").count() == 4
    assert jobs.finalize_auditor(spark, store, "aud", NOW + 7, wait_s=0).boundary_ms == NOW - 15_000


def test_too_few_tables(spark):
    s = Store(spark, tempfile.mkdtemp(prefix="spark-") + "/store")
    s.publish({"a": s.stage("a", records(spark, "a"))})
    with pytest.raises(TooFewTargets):
        jobs.finalize_records(spark, s, NOW)
    assert s.run("ledger") is None


def test_corrupt_state_fails(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    with open(f"{root}/_live.json", "w") as f:
        f.write("{not json")
    with pytest.raises(CorruptState):
        Store(spark, root).tables()


def test_two_writers_keep_each_others_tables_and_marks(spark, store):
    """The second writer publishes between the first one's reading and its publishing."""
    first, second = Store(spark, store.root), Store(spark, store.root)
    load = first._load

    def slow():
        found = load()
        first._load = load
        second.publish({"b": second.stage("b", records(spark, "z"))}, {"other": {"completed": ["b"]}, "same": {"completed": ["b"]}})
        return found

    first._load = slow
    first.publish({"a": first.stage("a", records(spark, "y"))}, {"same": {"completed": ["a"]}})
    assert store.read("a").where("pk LIKE 'y%'").count() == store.read("b").where("pk LIKE 'z%'").count() == 10
    assert store.run("other") == {"completed": ["b"]} and store.run("same") == {"completed": ["b", "a"]}


def test_a_change_of_a_changed_table_is_made_again(spark, store):
    entry = store.entry("a")
    store.publish({"a": store.appended("a", records(spark, "late"), entry)})
    with pytest.raises(LostUpdate):
        store.publish({"a": store.stage("a", records(spark, "y"))}, based_on={"a": entry})
    revised, calls = store.revised, []

    def interrupted(table, seen, *rest):
        if not calls:
            calls.append(table)
            store.publish({table: store.appended(table, records(spark, "later"), seen)})
        return revised(table, seen, *rest)

    store.revised = interrupted
    report = jobs.finalize_records(spark, store, NOW)
    assert calls == ["a"] and report.counts["a"]["scanned"] == 30
    assert store.read("a").where("tx_state <> 'COMMITTED'").isEmpty()


def test_only_files_with_selected_rows_are_written_anew(spark, store):
    frame = spark.range(0, 40, 1, 8).selectExpr("concat('k', id) AS nonce", "id AS registered_at")
    store.publish({"request_proof": store.stage("request_proof", frame)})
    before = glob.glob(f"{store.root}/request_proof/*/*.parquet")
    report = jobs.cleanup_proofs(spark, store, jobs.watermarks.token(spark, "auditor", 7))
    assert report.counts["request_proof"] == {"scanned": 40, "changed": 7}
    assert sorted(r.registered_at for r in store.read("request_proof").collect()) == list(range(7, 40))
    entry = store.entry("request_proof")
    assert len(entry) == 2 and len(entry[0]["without"]) == 2  # five rows are in each of the eight files
    fresh = set(glob.glob(f"{store.root}/request_proof/*/*.parquet")) - set(before)
    assert sum(spark.read.parquet(f).count() for f in fresh) == 3


def test_proofs_of_held_locks_are_kept(spark, store):
    store.publish({"request_proof": store.stage("request_proof", spark.createDataFrame([("n1", OLD)], "nonce string, registered_at long"))})
    token = jobs.watermarks.token(spark, "auditor", NOW)
    with pytest.raises(jobs.UnsafeDeletion, match="n1"):
        jobs.cleanup_proofs(spark, store, token)
    jobs.finalize_locks(spark, store, "aud", NOW, wait_s=0)
    assert jobs.cleanup_proofs(spark, store, token).counts["request_proof"] == {"scanned": 1, "changed": 1}


def test_states_may_be_numbers(spark, store):
    codes = {1: "PREPARED", 2: "DELETED", 3: "COMMITTED", 4: "ABORTED"}
    number = F.create_map(*[F.lit(x) for code, name in codes.items() for x in (name, code)])
    coded = {t: store.read(t).withColumn("tx_state", number[F.col("tx_state")]) for t in ("a", "b", "empty")}
    coded["coordinator_state"] = store.read("coordinator_state").withColumn("c_state", number[F.col("c_state")])
    store.publish({t: store.stage(t, df) for t, df in coded.items()})
    spec, outcomes = replace(LEDGER, state_codes=codes), replace(COORDINATOR, state_codes=codes)
    report = jobs.finalize_records(spark, store, NOW, spec=spec, coordinator_spec=outcomes)
    assert report.counts["a"]["changed"] == 8
    assert {(r.pk, r.tx_state) for r in store.read("a").collect()} == {(f"a{i}", 3) for i in range(10) if i % 5 in (0, 2, 3)}
    assert store.read("coordinator_state").where("c_state = 4 AND tx_created_at = 1000000").count() == 8
    with pytest.raises(Exception, match="unknown tx_state 9"):
        spec.named(store.read("a").withColumn("tx_state", F.lit(9))).collect()


def test_recovery_of_records_can_be_replaced(spark, store):
    seen = []

    def leave_all(rows, coordinator, boundary, now):
        seen.append((rows.count(), boundary, now))
        return rows.withColumns({"c_state": F.lit(None).cast("string"), "action": F.lit(recovery.SKIP)})

    report = jobs.finalize_records(spark, store, NOW, recover_fn=leave_all)
    assert seen == [(8, NOW, NOW)] * 2 and report.counts["a"] == {"scanned": 10, "changed": 0}
    assert store.read("a").where("tx_state <> 'COMMITTED'").count() == 8


def test_recorded_watermarks_replace_tokens(spark, store):
    assert jobs.recorded_boundary(store) is None
    jobs.finalize_records(spark, store, NOW)
    jobs.finalize_records(spark, store, NOW + 9)  # a rerun records nothing new
    assert store.read("watermarks").count() == 1 and jobs.recorded_boundary(store) is None
    jobs.finalize_auditor(spark, store, "aud", NOW, wait_s=0)
    assert jobs.recorded_boundary(store) == NOW - 15_000
    assert jobs.cleanup_coordinator(spark, store).boundary_ms == NOW - 15_000


def test_shared_folder(spark, tmp_path):
    frame = shared.written(spark.range(3), "x")
    name = shared.shared_table(spark, "kept")
    spark.range(2).write.saveAsTable(name)
    assert frame.count() == 3 and glob.glob(f"{shared.shared_dir(spark)}/x-*")
    keep, spark.sparkContext.master = spark.sparkContext.master, "spark://host:7077"
    try:
        if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            with pytest.raises(shared.NoSharedFolder):
                shared.shared_dir(spark)
    finally:
        spark.sparkContext.master = keep
    shared.clean_up(spark)
    assert not glob.glob(f"{shared.shared_dir(spark)}/*") and not spark.catalog.tableExists(name)


SCAN = TableSpec("t", "pk string, ck int, val string", ("pk", "ck"), "ck")


@pytest.fixture
def table(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    rows = [(f"partition-{i % 5}", i, "v") for i in range(600)]
    spark.createDataFrame(rows, SCAN.schema).repartition(6).write.parquet(f"{path}/t")
    return path


def test_scan_resumes_after_a_failure(spark, table):
    calls, write = [], scan.write_batch(f"{table}/out")

    def handler(batch, number):
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("stopped")
        write(batch, number)

    with pytest.raises(Exception, match="stopped"):
        scan.resumable_scan(spark, f"{table}/t", SCAN, handler, f"{table}/run", files_per_batch=2)
    got = scan.resumable_scan(spark, f"{table}/t", SCAN, handler, f"{table}/run", files_per_batch=2)
    assert calls == [0, 1, 1, 2] and got.batches == 2
    rows = spark.read.parquet(f"{table}/out")
    assert rows.count() == 600 and scan.latest(rows, ("ck",)).count() == 600
    assert scan.resumable_scan(spark, f"{table}/t", SCAN, handler, f"{table}/run").rows == 0


def test_scan_with_lost_position_delivers_all_again(spark, table):
    write = scan.write_batch(f"{table}/out")
    assert scan.resumable_scan(spark, f"{table}/t", SCAN, write, f"{table}/run1").rows == 600
    assert scan.resumable_scan(spark, f"{table}/t", SCAN, write, f"{table}/run2").rows == 600
    assert scan.latest(spark.read.parquet(f"{table}/out"), ("ck",)).count() == 600


def test_scan_of_an_empty_table(spark, table):
    spark.createDataFrame([], SCAN.schema).write.parquet(f"{table}/none")
    assert scan.resumable_scan(spark, f"{table}/none", SCAN, scan.write_batch(f"{table}/o"), f"{table}/r").rows == 0


def test_scan_with_corrupt_position_fails(spark, table):
    write = scan.write_batch(f"{table}/out")
    scan.resumable_scan(spark, f"{table}/t", SCAN, write, f"{table}/run", files_per_batch=2)
    for file in glob.glob(f"{table}/run/checkpoint/offsets/[0-9]*"):
        with open(file, "w") as f:
            f.write("not a position")
    for file in glob.glob(f"{table}/run/checkpoint/offsets/.*.crc"):
        open(file, "w").close()
    with pytest.raises(Exception):
        scan.resumable_scan(spark, f"{table}/t", SCAN, write, f"{table}/run")


def test_files_that_come_after_the_listing_wait_for_the_next_run(spark, table):
    """The listing is taken when the run starts; one that has gone stale is taken anew by the next run."""
    write, late = scan.write_batch(f"{table}/out"), spark.createDataFrame([("partition-9", 600 + i, "late") for i in range(9)], SCAN.schema).coalesce(1)

    def handler(batch, number):
        if number == 0:
            late.write.mode("append").parquet(f"{table}/t")
        write(batch, number)

    first = scan.resumable_scan(spark, f"{table}/t", SCAN, handler, f"{table}/run", files_per_batch=2)
    second = scan.resumable_scan(spark, f"{table}/t", SCAN, write, f"{table}/run", files_per_batch=2)
    assert (first.rows, second.rows) == (600, 9)
    assert scan.latest(spark.read.parquet(f"{table}/out"), ("ck",)).count() == 609


def test_scan_counts_rows_of_a_handler_that_reads_none(spark, table):
    assert scan.resumable_scan(spark, f"{table}/t", SCAN, lambda batch, number: None, f"{table}/run").rows == 600


def test_documents_need_a_schema(spark):
    raw = spark.createDataFrame([(1, '{"k": 5}'), (2, None)], "id int, doc string")
    assert [tuple(r) for r in typed(raw, "doc", "k bigint").orderBy("id").collect()] == [(1, 5), (2, None)]
    with pytest.raises(ValueError):
        typed(raw, "doc", None)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        typed(spark.createDataFrame([("{x",)], "doc string"), "doc", "k bigint").collect()
