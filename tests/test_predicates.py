"""Rules on rows: strict boundaries, nulls, unknown codes, missing columns."""

import pytest

from tidemark.operators import locks, predicates, retention
from tidemark.schemas import LEDGER, MissingColumns

B = 1_000_000_000


def select(spark, rows, schema, predicate):
    return [r[0] for r in spark.createDataFrame(rows, schema).where(predicate).collect()]


def test_records_in_doubt(spark):
    rows = [("a", "PREPARED", 999), ("b", "DELETED", 999), ("c", "COMMITTED", 500), ("d", "PREPARED", 1001), ("e", "PREPARED", 1000), ("f", None, 1), ("g", "DELETED", None)]
    assert select(spark, rows, "pk string, tx_state string, tx_prepared_at long", predicates.needs_finalization(1000)) == ["a", "b"]


def test_locks_by_kind_and_age(spark):
    rows = [("0", 1, 1), ("1", 3, 1), ("2", 2, 1), ("3", 3, 2**53), ("4", 2, 2**53), ("5", 3, B), ("6", 3, B - 1)]
    assert select(spark, rows, "id string, lock_type int, last_updated_at long", predicates.needs_release(B)) == ["1", "2", "4", "6"]


@pytest.mark.parametrize("row", [("x", 99, 1), ("x", None, 1), ("x", 3, None)])
def test_bad_locks_fail_the_job(spark, row):
    with pytest.raises(Exception, match="unknown lock type|has no time"):
        select(spark, [row], "id string, lock_type int, last_updated_at long", predicates.needs_release(B))


def test_selected_rows_need_a_key(spark):
    rows = spark.createDataFrame([("n", None, 2, 1)], "ns string, id string, lock_type int, last_updated_at long")
    with pytest.raises(Exception, match="has no id"):
        locks.candidates(rows, B).collect()
    proofs = spark.createDataFrame([(None, 1)], "nonce string, registered_at long")
    with pytest.raises(Exception, match="has no nonce"):
        retention.tombstones(proofs, predicates.proof_deletable(B), ("nonce",)).collect()


@pytest.mark.parametrize("boundary,gone", [(B - 10000, set()), (B, {"old-committed", "old-aborted"}), (B + 10001, {"old-committed", "old-aborted", "boundary", "new-committed", "new-aborted"})])
def test_coordinator_rows_by_age_only(spark, boundary, gone):
    rows = [("old-committed", B - 10000), ("old-aborted", B - 5000), ("boundary", B), ("new-committed", B + 5000), ("new-aborted", B + 10000), ("null", None)]
    assert set(select(spark, rows, "tx_id string, tx_created_at long", predicates.coordinator_deletable(boundary))) == gone
    df = spark.createDataFrame(rows, "tx_id string, tx_created_at long")
    left = retention.survivors(df, predicates.coordinator_deletable(boundary))
    assert {r.tx_id for r in left.collect()} == {r[0] for r in rows} - gone
    n = retention.counts(df, predicates.coordinator_deletable(boundary)).first()
    assert (n.scanned, n.deleted, n.kept) == (6, len(gone), 6 - len(gone))


@pytest.mark.parametrize("boundary,gone", [(B - 10000, set()), (B, {"old"}), (B + 10001, {"old", "boundary", "new"})])
def test_proofs_by_age(spark, boundary, gone):
    rows = [("old", B - 10000), ("boundary", B), ("new", B + 10000), ("null", None)]
    assert set(select(spark, rows, "nonce string, registered_at long", predicates.proof_deletable(boundary))) == gone


def test_missing_columns_are_errors(spark):
    with pytest.raises(MissingColumns, match="tx_state"):
        LEDGER.check(spark.createDataFrame([("a",)], "pk string"))
    with pytest.raises(Exception, match="tx_state"):
        spark.createDataFrame([("a",)], "pk string").where(predicates.needs_finalization(1)).collect()
