"""The versioned store: layout by age, many replaced files, runs of several writers, and reclaiming space."""

import glob
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators.predicates import proof_deletable
from tidemark.schemas import COORDINATOR, PROOFS
from tidemark.sources import reclaim, snapshot
from tidemark.sources.snapshot import DAY_MS, LostUpdate, Store

PROOF = "nonce string, registered_at long"


@pytest.fixture
def store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="spark-") + "/store")


def proofs(spark, days, per_day=10):
    return spark.range(0, days * per_day, 1, 4).select(F.concat(F.lit("n"), "id").alias("nonce"), (F.col("id") % days * DAY_MS + F.col("id")).alias("registered_at"))


def keep_by_age(store, frame, table=jobs.PROOF_TABLE, spec=PROOFS, width=DAY_MS):
    store.publish({table: store.laid_out(table, frame, spec.age_col, spec.keys, width)})


def token(spark, ms, server="auditor"):
    return jobs.watermarks.token(spark, server, ms)


def test_selected_rows_without_key_fail_the_deletion(spark, store):
    store.publish({"request_proof": store.stage("request_proof", spark.createDataFrame([("a", 5), (None, 6), (None, None)], PROOF))})
    before = store.entry("request_proof")
    with pytest.raises(Exception, match="no nonce"):
        jobs.cleanup_proofs(spark, store, token(spark, 7))
    assert store.entry("request_proof") == before and store.run("proofs")["completed"] is False
    store.publish({"request_proof": store.stage("request_proof", spark.createDataFrame([("a", 5), (None, 9), (None, None)], PROOF))})
    assert jobs.cleanup_proofs(spark, store, token(spark, 7)).counts["request_proof"] == {"scanned": 3, "changed": 1}
    rows = spark.createDataFrame([("t", "COMMITTED", 5), (None, "ABORTED", 5)], COORDINATOR.schema)
    store.publish({"coordinator_state": store.stage("coordinator_state", rows)})
    with pytest.raises(Exception, match="no tx_id"):
        jobs.cleanup_coordinator(spark, store, token(spark, 7, "ledger"), token(spark, 7))
    assert store.read("coordinator_state").count() == 2


def test_selected_rows_without_key_fail_the_deletion_by_age(spark, store):
    rows = spark.createDataFrame([("a", 5), (None, 6), (None, None), ("b", 3 * DAY_MS)], PROOF)
    keep_by_age(store, rows)
    with pytest.raises(Exception, match="no nonce"):
        jobs.cleanup_proofs(spark, store, token(spark, 2 * DAY_MS))
    assert store.read("request_proof").count() == 4
    assert jobs.cleanup_proofs(spark, store, token(spark, 6), run="earlier").counts["request_proof"] == {"scanned": 4, "changed": 1}
    assert sorted(str(r.nonce) for r in store.read("request_proof").collect()) == ["None", "None", "b"]


def test_two_writers_of_a_run_have_one_boundary(spark, store):
    """Both find no run; the second to store its boundary takes over the first one's."""
    first, second = Store(spark, store.root), Store(spark, store.root)
    run, states = second.run, []

    def late(name):
        found = run(name)
        if not states:
            states.append(jobs._begin(first, "ledger", {"started_at_ms": 999_000, "targets": ["x", "y"], "completed": []}))
            first.publish({}, {"ledger": jobs._completed(states[0], "x")})
        return found

    second.run = late
    state = jobs._begin(second, "ledger", {"started_at_ms": 1_000_000, "targets": ["x", "y"], "completed": []})
    assert state["started_at_ms"] == 999_000 and state["completed"] == ["x"]
    with pytest.raises(LostUpdate):
        second.publish({}, {"ledger": {"started_at_ms": 1_000_000, "targets": ["x", "y"], "completed": ["y"]}})
    with pytest.raises(LostUpdate):
        second.publish({}, {"ledger": state}, fresh_runs=True)
    second.publish({}, {"ledger": jobs._completed(state, "y")})
    assert store.run("ledger")["completed"] == ["x", "y"] and store.run("ledger")["started_at_ms"] == 999_000


def test_no_token_is_above_what_a_target_was_done_with(spark, store):
    """The race that once gave a token of 1,000,000 although one target was done with 999,000."""
    columns = "pk string, tx_id string, tx_state string, tx_prepared_at long, val double, before_val double"
    rows = {t: spark.createDataFrame([(f"{t}1", f"{t}1", "PREPARED", 500, 1.0, None), (f"{t}2", f"{t}2", "PREPARED", 999_500, 1.0, None)], columns) for t in "xy"}
    rows["coordinator_state"] = spark.createDataFrame([(f"{t}{i}", "COMMITTED", 1) for t in "xy" for i in (1, 2)], COORDINATOR.schema)
    store.publish({t: store.stage(t, df) for t, df in rows.items()})
    second, run, once = Store(spark, store.root), store.run, []

    def late(name):
        found = run(name)
        if name == "ledger" and not once:
            once.append(jobs.finalize_records(spark, second, 999_000))
        return found

    store.run = late
    report = jobs.finalize_records(spark, store, 1_000_000)
    assert report.boundary_ms == 999_000 and report.token == once[0].token == token(spark, 999_000, "ledger")
    assert all(store.read(t).where("tx_state = 'PREPARED' AND tx_prepared_at < 999000").isEmpty() for t in "xy")


def test_deletion_by_age_reads_the_edge_bucket_only(spark, store):
    keep_by_age(store, proofs(spark, 30))
    plan = store._segment("request_proof", store.entry("request_proof")[0] | {"since": 20})._jdf.queryExecution().toString()
    assert "PartitionFilters: [((isnull(_age" in plan and "20" in plan.split("PartitionFilters")[1]
    boundary = 20 * DAY_MS + 51
    report = jobs.cleanup_proofs(spark, store, token(spark, boundary))
    want = sorted(r.nonce for r in proofs(spark, 30).where(~proof_deletable(boundary)).collect())
    assert report.counts["request_proof"] == {"scanned": 300, "changed": 300 - len(want)}
    assert sorted(r.nonce for r in store.read("request_proof").collect()) == want
    entry = store.entry("request_proof")
    assert entry[0]["since"] == 21 and len(entry) == 2 and not entry[0]["without"]
    fresh = glob.glob(f"{store.root}/request_proof/{entry[1]['at']}/*/*.parquet")
    assert len(fresh) == 1 and "_age=20" in fresh[0]
    again = jobs.cleanup_proofs(spark, store, token(spark, boundary), run="again")
    assert again.counts["request_proof"] == {"scanned": len(want), "changed": 0} and store.entry("request_proof") == entry


def test_a_deletion_opens_no_file_of_older_buckets(spark, store):
    """They are overwritten with what isn't Parquet: whoever opened one would fail."""
    keep_by_age(store, proofs(spark, 40))
    for f in glob.glob(f"{store.root}/request_proof/*/_age=*/*"):
        if int(f.split("_age=")[1].split("/")[0]) < 38:
            with open(f, "wb") as out:
                out.write(b"nothing that can be read")
    boundary = 38 * DAY_MS + 100
    report = jobs.cleanup_proofs(spark, store, token(spark, boundary))
    want = proofs(spark, 40).where(~proof_deletable(boundary))
    assert report.counts["request_proof"] == {"scanned": 400, "changed": 400 - want.count()}
    assert sorted(r.nonce for r in store.read("request_proof").collect()) == sorted(r.nonce for r in want.collect())


def test_all_rows_of_a_table_by_age_may_go(spark, store):
    keep_by_age(store, proofs(spark, 3))
    jobs.cleanup_proofs(spark, store, token(spark, 9 * DAY_MS))
    assert store.read("request_proof").count() == 0 and store.read("request_proof").columns == ["nonce", "registered_at"]
    keep_by_age(store, proofs(spark, 3).limit(0))
    assert store.read("request_proof").count() == 0
    assert jobs.cleanup_proofs(spark, store, token(spark, 9), run="none").counts["request_proof"] == {"scanned": 0, "changed": 0}


@pytest.mark.parametrize("named", [1000, 1])
def test_only_hit_files_are_written_anew_however_many(spark, store, monkeypatch, named):
    monkeypatch.setattr(snapshot, "NAMED", named)
    monkeypatch.setattr(snapshot, "BROADCAST_FILES", named)
    monkeypatch.setattr(snapshot, "SEGMENTS", 3)
    frame = spark.range(0, 80, 1, 8).selectExpr("concat('k', id) AS nonce", "id AS registered_at")
    store.publish({"request_proof": store.stage("request_proof", frame)})
    for boundary, hit in ((25, 3), (41, 4), (80, 0)):
        before = set(glob.glob(f"{store.root}/request_proof/**/*.parquet", recursive=True))
        jobs.cleanup_proofs(spark, store, token(spark, boundary), run=f"proofs{boundary}")
        assert sorted(r.registered_at for r in store.read("request_proof").collect()) == list(range(boundary, 80))
        fresh = {f for f in glob.glob(f"{store.root}/request_proof/**/*.parquet", recursive=True) if "/_" not in f} - before
        assert sum(spark.read.parquet(f).count() for f in fresh) < 10 * max(1, hit)
    entry = store.entry("request_proof")
    assert len(entry) == 1  # segments of which no file is left aren't named any more


def test_many_small_segments_are_merged_and_large_ones_stay(spark, store, monkeypatch):
    monkeypatch.setattr(snapshot, "SEGMENTS", 4)
    entry = [store._staged("t", spark.range(100_000).selectExpr("cast(id AS string) AS nonce", "id AS registered_at"), None)]
    large = entry[0]["at"]
    for i in range(9):
        entry = store.appended("t", spark.createDataFrame([(f"x{i}", i)], PROOF), entry)
        assert len(entry) <= 4 and large in [s["at"] for s in entry]
    assert store.read("t", entry=entry).count() == 100_009


def size(root):
    return sum(os.path.getsize(f) for f in glob.glob(f"{root}/**/*.parquet", recursive=True))


@pytest.mark.parametrize("by_age", [False, True])
def test_reclaiming_space(spark, store, by_age):
    frame = spark.range(0, 20_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("nonce"), (F.col("id") * 100_000).alias("registered_at"))
    if by_age:
        keep_by_age(store, frame)
    else:
        store.publish({"request_proof": store.stage("request_proof", frame)})
    full, reader = size(store.root), store.read("request_proof")
    boundary = 19_000 * 100_000
    jobs.cleanup_proofs(spark, store, token(spark, boundary))
    assert size(store.root) > full
    kept = reclaim.reclaim(store)  # within the grace period
    assert kept.pointers == 0 and kept.tables["request_proof"]["dead_files"] == 0 and reader.count() == 20_000
    store.stage("request_proof", frame)  # never made live
    time.sleep(0.05)
    gone = reclaim.reclaim(store, grace_ms=0)
    assert gone.tables["request_proof"]["dead_bytes"] > 0 and gone.pointers >= 1
    assert size(store.root) < full * 0.3 and gone.frame(spark).count() == 1
    assert store.read("request_proof").count() == 1000
    again = reclaim.reclaim(store, grace_ms=0)
    assert again.tables["request_proof"]["dead_files"] == 0 and again.pointers == 0
    jobs.cleanup_proofs(spark, store, token(spark, boundary + 500 * 100_000), run="next")
    assert store.read("request_proof").count() == 500


def test_reclaiming_keeps_what_a_late_reader_needs(spark, store):
    """Two deletions; the pointer between them was replaced within the grace period, the first one before it."""
    frame = spark.range(0, 80, 1, 8).selectExpr("concat('k', id) AS nonce", "id AS registered_at")
    store.publish({"request_proof": store.stage("request_proof", frame)})
    first = store.entry("request_proof")
    jobs.cleanup_proofs(spark, store, token(spark, 25), run="one")
    second = store.entry("request_proof")
    time.sleep(1.2)
    between = int(time.time() * 1000)
    time.sleep(1.2)
    jobs.cleanup_proofs(spark, store, token(spark, 45), run="two")
    now = int(time.time() * 1000)
    report = reclaim.reclaim(store, grace_ms=now - between, now_ms=now)
    assert report.tables["request_proof"]["dead_files"] > 0
    assert store.read("request_proof", entry=second).count() == 55 and store.read("request_proof").count() == 35
    assert store.read("request_proof", entry=first).count() < 80  # its files are gone


def test_reclaiming_with_named_frames(spark, store, monkeypatch):
    monkeypatch.setattr(snapshot, "NAMED", 1)
    frame = spark.range(0, 80, 1, 8).selectExpr("concat('k', id) AS nonce", "id AS registered_at")
    store.publish({"request_proof": store.stage("request_proof", frame)})
    jobs.cleanup_proofs(spark, store, token(spark, 35))
    assert store.entry("request_proof")[0]["gone"]
    time.sleep(0.05)
    assert reclaim.reclaim(store, grace_ms=0).tables["request_proof"]["dead_files"] == 4
    assert sorted(r.registered_at for r in store.read("request_proof").collect()) == list(range(35, 80))
