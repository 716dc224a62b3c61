"""The recovery matrix, and what the actions leave behind."""

import pytest

from tidemark.operators import audit, locks, recovery
from tidemark.operators.predicates import coordinator_deletable

NOW, OLD, FRESH = 100_000, 10_000, 90_000
SCHEMA = "pk string, tx_id string, tx_state string, tx_prepared_at long, val double, before_val double"
CASES = [
    ("committed", "COMMITTED", OLD, 1.0, None, "COMMITTED", "KEEP"), ("newer", "PREPARED", NOW, 1.0, None, None, "KEEP"), ("null state", None, OLD, 1.0, None, None, "KEEP"),
    ("forward", "PREPARED", OLD, 2.0, 1.0, "COMMITTED", "ROLL_FORWARD"), ("remove", "DELETED", OLD, 2.0, 1.0, "COMMITTED", "REMOVE"),
    ("fresh forward", "PREPARED", FRESH, 2.0, 1.0, "COMMITTED", "ROLL_FORWARD"), ("insert", "PREPARED", OLD, 2.0, None, None, "ROLLBACK_REMOVE"),
    ("update", "PREPARED", OLD, 2.0, 1.0, None, "ROLLBACK_RESTORE"), ("delete", "DELETED", OLD, 2.0, 1.0, None, "ROLLBACK_RESTORE"),
    ("aborted insert", "PREPARED", FRESH, 2.0, None, "ABORTED", "ROLLBACK_REMOVE"), ("aborted delete", "DELETED", OLD, 2.0, 1.0, "ABORTED", "ROLLBACK_RESTORE"),
    ("skip", "PREPARED", FRESH, 2.0, None, None, "SKIP"), ("edge", "PREPARED", NOW - 15_000, 2.0, None, None, "ROLLBACK_REMOVE"),
]


@pytest.fixture(scope="module", params=[False, True])
def resolved(spark, request):
    records = spark.createDataFrame([(n, f"tx {n}", s, at, v, b) for n, s, at, v, b, _, _ in CASES], SCHEMA)
    coordinator = spark.createDataFrame([(f"tx {n}", c, OLD) for n, *_, c, _ in CASES if c], "tx_id string, c_state string, tx_created_at long")
    return recovery.resolve(records, coordinator, NOW, NOW, thin=request.param), coordinator


def test_matrix(resolved):
    assert {r.pk: r.action for r in resolved[0].collect()} == {c[0]: c[-1] for c in CASES}


def test_snapshot_and_aborts(resolved):
    after = {r.pk: (r.tx_state, r.val) for r in recovery.applied(resolved[0]).collect()}
    assert not {"remove", "insert", "aborted insert", "edge"} & set(after)
    assert after["forward"] == ("COMMITTED", 2.0) and after["update"] == ("COMMITTED", 1.0) and after["delete"] == ("COMMITTED", 1.0)
    assert after["skip"] == ("PREPARED", 2.0) and after["newer"] == ("PREPARED", 1.0) and after["null state"] == (None, 1.0)
    aborts = recovery.new_aborts(resolved[0], NOW).collect()
    assert {r.tx_id for r in aborts} == {"tx insert", "tx update", "tx delete", "tx edge"}
    assert {(r.c_state, r.tx_created_at) for r in aborts} == {("ABORTED", NOW)}
    n = recovery.counts(resolved[0]).first()
    assert (n.scanned, n.finalized) == (len(CASES), sum(c[-1] not in ("KEEP", "SKIP") for c in CASES))


def test_unsafe_deletes_vanish_with_finalization(resolved):
    frame, coordinator = resolved
    records = frame.drop("c_state", "action")
    before = audit.unsafe_coordinator_deletes(coordinator, records, coordinator_deletable(NOW), NOW)
    after = audit.unsafe_coordinator_deletes(coordinator, recovery.applied(frame), coordinator_deletable(NOW), NOW)
    assert before.count() == 5 and after.isEmpty()


def test_lock_recovery_is_tried_again(spark):
    held = spark.createDataFrame([("n", str(i)) for i in range(9)], "ns string, id string")
    tries = []

    def rule(frame, attempt):
        tries.append(frame.count())
        return frame.selectExpr("ns", "id", f"CASE WHEN id % 3 < {attempt} THEN IF(id = 0, 'NOT_NEEDED', 'SUCCEEDED') ELSE 'NOT_RECOVERABLE' END AS outcome")

    done = {int(r.id): r.attempt for r in locks.recover(held, rule, wait_s=0).collect()}
    assert done == {i: i % 3 + 1 for i in range(9)} and tries == [9, 6, 3]


@pytest.mark.parametrize("outcome", ["'FAILED'", "'ODD'", "CAST(NULL AS STRING)", "'NOT_RECOVERABLE'"])
def test_lock_recovery_fails(spark, outcome):
    held = spark.createDataFrame([("n", "1")], "ns string, id string")
    with pytest.raises(locks.RecoveryFailed):
        locks.recover(held, lambda frame, _: frame.selectExpr("ns", "id", f"{outcome} AS outcome"), attempts=2, wait_s=0)


def test_proofs_of_held_locks_are_unsafe(spark):
    proofs = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", None)], "nonce string, registered_at long")
    held = spark.createDataFrame([(3, 5, ["a"]), (3, 11, ["b"]), (1, 5, ["c"]), (3, 5, None)], "lock_type int, last_updated_at long, owner_nonces array<string>")
    found = audit.unsafe_proof_deletes(proofs, held, proofs.registered_at < 20, 20)
    assert [r.nonce for r in found.collect()] == ["a"]
