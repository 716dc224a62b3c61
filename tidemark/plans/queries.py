"""One query per operator, over the views in :mod:`tidemark.fixtures`, and the SQL that checks it."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark import jobs
from tidemark.functions import names, times, tokens
from tidemark.operators import audit, locks, recovery, retention, watermarks
from tidemark.operators.predicates import coordinator_deletable, needs_finalization, needs_release, proof_deletable
from tidemark.schemas import LOCK_VALID_MS, TableSpec
from tidemark.sources import discovery, documents, reclaim
from tidemark.sources.shared import shared_dir, written
from tidemark.sources.snapshot import DAY_MS, Store
from tidemark.streaming import scan

G, B = fx.LEDGER_MS, fx.LOCK_MS
FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` may use the fixture views and {G} and {B}."""

    def add(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {fx.SQL.strip()}{sql.replace('{G}', str(G)).replace('{B}', str(B)).strip()}"
        return f

    return add


CANDIDATE = "tx_state IN ('PREPARED', 'DELETED') AND tx_prepared_at < {G}"
RELEASE = "CASE lock_type WHEN 2 THEN true WHEN 3 THEN last_updated_at < {B} ELSE false END"
RESOLVED = f"""
, resolved AS (
  SELECT r.*, c.c_state, CASE
    WHEN NOT ({CANDIDATE}) THEN 'KEEP'
    WHEN c_state = 'COMMITTED' THEN CASE WHEN tx_state = 'PREPARED' THEN 'ROLL_FORWARD' ELSE 'REMOVE' END
    WHEN c_state IS NULL AND {{G}} - tx_prepared_at < 15000 THEN 'SKIP'
    WHEN tx_state = 'PREPARED' AND before_val IS NULL THEN 'ROLLBACK_REMOVE'
    ELSE 'ROLLBACK_RESTORE' END AS action
  FROM ledger_records r LEFT JOIN coordinator_state c ON r.tx_id = c.tx_id AND {CANDIDATE})
, snapshot AS (
  SELECT pk, tx_id, CASE WHEN action IN ('ROLL_FORWARD', 'ROLLBACK_RESTORE') THEN 'COMMITTED' ELSE tx_state END AS tx_state, tx_prepared_at,
         CASE WHEN action = 'ROLLBACK_RESTORE' THEN before_val ELSE val END AS val, before_val
  FROM resolved WHERE action NOT IN ('REMOVE', 'ROLLBACK_REMOVE'))
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.resolve(fx.ledger_records(spark, sf_dir), fx.coordinator_state(spark, sf_dir), G, G)


@query(f" SELECT * FROM ledger_records WHERE {CANDIDATE}")
def finalize_candidates(spark, sf_dir):
    """In-doubt records older than the boundary."""
    return fx.ledger_records(spark, sf_dir).where(needs_finalization(G))


@query(f"{RESOLVED} SELECT pk, tx_state, c_state, action FROM resolved")
def recovery_actions(spark, sf_dir):
    """What becomes of each record."""
    return _resolved(spark, sf_dir).select("pk", "tx_state", "c_state", "action")


@query(f"{RESOLVED} SELECT action, count(*) AS n FROM resolved GROUP BY action")
def recovery_action_counts(spark, sf_dir):
    """Records by action."""
    return _resolved(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"{RESOLVED} SELECT * FROM snapshot")
def recovered_snapshot(spark, sf_dir):
    """The records after their actions."""
    return recovery.applied(_resolved(spark, sf_dir))


@query(f"{RESOLVED} SELECT DISTINCT tx_id, 'ABORTED' AS c_state, {{G}}::BIGINT AS tx_created_at FROM resolved WHERE action LIKE 'ROLLBACK%' AND c_state IS NULL")
def new_abort_rows(spark, sf_dir):
    """Coordinator rows of transactions rolled back without an outcome."""
    return recovery.new_aborts(_resolved(spark, sf_dir), G)


@query(" SELECT * FROM coordinator_state WHERE coalesce(tx_created_at >= {G}, true)")
def coordinator_survivors(spark, sf_dir):
    return retention.survivors(fx.coordinator_state(spark, sf_dir), coordinator_deletable(G))


@query(" SELECT tx_id FROM coordinator_state WHERE tx_created_at < {G}")
def coordinator_deleted(spark, sf_dir):
    return retention.tombstones(fx.coordinator_state(spark, sf_dir), coordinator_deletable(G), ("tx_id",))


@query(" SELECT * FROM request_proof WHERE coalesce(registered_at >= {B}, true)")
def proof_survivors(spark, sf_dir):
    return retention.survivors(fx.request_proof(spark, sf_dir), proof_deletable(B))


@query(" SELECT count(*) AS scanned, count(*) FILTER (registered_at < {B}) AS deleted, count(*) FILTER (coalesce(registered_at >= {B}, true)) AS kept FROM request_proof")
def proof_deleted_counts(spark, sf_dir):
    return retention.counts(fx.request_proof(spark, sf_dir), proof_deletable(B))


@query(" SELECT * FROM coordinator_state WHERE tx_id NOT IN (SELECT tx_id FROM coordinator_state WHERE tx_created_at < {G})")
def keyed_delete_anti(spark, sf_dir):
    """Deletion by exact key."""
    rows = fx.coordinator_state(spark, sf_dir)
    return retention.without_keys(rows, retention.tombstones(rows, coordinator_deletable(G), ("tx_id",)))


@query(" SELECT ns || '.' || tbl AS full_name FROM catalog_tables WHERE is_tx AND ns || '.' || tbl <> 'america.nation_1'")
def target_tables(spark, sf_dir):
    """Transactional tables other than the coordinator's."""
    return discovery.targets(fx.catalog_tables(spark, sf_dir), fx.COORDINATOR_NAME).select("full_name")


@query(" SELECT ns || '.' || tbl AS full_name FROM catalog_tables WHERE is_tx AND ns || '.' || tbl <> 'america.nation_1' AND NOT completed")
def pending_targets(spark, sf_dir):
    found = discovery.targets(fx.catalog_tables(spark, sf_dir), fx.COORDINATOR_NAME)
    return discovery.pending(found, found.where("completed")).select("full_name")


@query(" SELECT count(*) AS targets, count(*) FILTER (completed) AS completed FROM catalog_tables WHERE is_tx AND ns || '.' || tbl <> 'america.nation_1'")
def target_progress(spark, sf_dir):
    """Completed of all targets."""
    found = discovery.targets(fx.catalog_tables(spark, sf_dir), fx.COORDINATOR_NAME)
    return found.agg(F.count(F.lit(1)).alias("targets"), F.count_if("completed").alias("completed"))


@query(" SELECT c.* FROM coordinator_state c WHERE tx_created_at < {G} AND tx_id IN (SELECT tx_id FROM ledger_records WHERE " + CANDIDATE + ")")
def unsafe_coordinator_deletes(spark, sf_dir):
    """Deletable coordinator rows that records not yet finalized still need."""
    return audit.unsafe_coordinator_deletes(fx.coordinator_state(spark, sf_dir), fx.ledger_records(spark, sf_dir), coordinator_deletable(G), G)


@query(f"{RESOLVED} SELECT count(*) AS n_unsafe FROM coordinator_state WHERE tx_created_at < {{G}} AND tx_id IN (SELECT tx_id FROM snapshot WHERE {CANDIDATE} AND {{G}} - tx_prepared_at >= 15000)")
def unsafe_after_finalization(spark, sf_dir):
    """None are left once the records are final; records that were skipped have no coordinator row."""
    rows = recovery.applied(_resolved(spark, sf_dir)).where(F.lit(G) - F.col("tx_prepared_at") >= recovery.EXPIRY_MS)
    found = audit.unsafe_coordinator_deletes(fx.coordinator_state(spark, sf_dir), rows, coordinator_deletable(G), G)
    return found.agg(F.count(F.lit(1)).alias("n_unsafe"))


@query(f" SELECT p.* FROM request_proof p JOIN (SELECT owner_nonce, min(last_updated_at) AS t FROM asset_lock WHERE lock_type = 3 AND last_updated_at < {{B}} GROUP BY 1) l ON p.nonce = l.owner_nonce WHERE registered_at < {{B}} AND t <= registered_at")
def unsafe_proof_deletes(spark, sf_dir):
    """Deletable proofs whose transaction still holds a write lock."""
    return audit.unsafe_proof_deletes(fx.request_proof(spark, sf_dir), fx.asset_lock(spark, sf_dir), proof_deletable(B), B)


@query(f" SELECT ns, id, lock_type, last_updated_at FROM asset_lock WHERE {RELEASE}")
def lock_candidates(spark, sf_dir):
    return locks.candidates(fx.asset_lock(spark, sf_dir), B).select("ns", "id", "lock_type", "last_updated_at")


@query(f" SELECT ns, count(*) AS scanned, count(*) FILTER ({RELEASE}) AS selected FROM asset_lock GROUP BY ns")
def lock_candidates_by_ns(spark, sf_dir):
    return locks.counts_by_namespace(fx.asset_lock(spark, sf_dir), needs_release(B))


@query(f" SELECT ns, id, CASE WHEN {RELEASE} THEN 1 ELSE lock_type END AS lock_type, last_updated_at FROM asset_lock")
def lock_release_applied(spark, sf_dir):
    """All locks after the release."""
    rows = fx.asset_lock(spark, sf_dir)
    done = locks.expired(locks.candidates(rows, B), 1)
    return locks.released(rows, done).select("ns", "id", "lock_type", "last_updated_at")


@query(f" SELECT ns, id, 'SUCCEEDED' AS outcome, (event_id % 3 + 1)::INT AS attempt FROM asset_lock WHERE {RELEASE}")
def lock_retry_outcomes(spark, sf_dir):
    """Locks that are recoverable on the first, second or third try only."""

    def try_(held: DataFrame, attempt: int) -> DataFrame:
        event = F.substring("id", 6, 20).cast("long")
        return held.select("ns", "id", F.when(event % 3 < attempt, locks.SUCCEEDED).otherwise(locks.NOT_RECOVERABLE).alias("outcome"))

    return locks.recover(locks.candidates(fx.asset_lock(spark, sf_dir), B), try_, wait_s=0).select("ns", "id", "outcome", "attempt")


@query(" SELECT name, min(ord) AS ord FROM (SELECT 'default' AS name, -1::BIGINT AS ord UNION ALL SELECT name, ord FROM namespace_registry WHERE partition_id = 0) GROUP BY name")
def namespaces(spark, sf_dir):
    return discovery.namespaces(fx.namespace_registry(spark, sf_dir), spark)


@query(" SELECT DISTINCT CASE WHEN ns = 'default' THEN 'auditor' ELSE 'auditor_' || ns END || '.asset_lock' AS full_name FROM asset_lock")
def physical_tables(spark, sf_dir):
    """The lock table of each logical namespace."""
    rows = fx.asset_lock(spark, sf_dir).select("ns").distinct()
    return rows.select(names.qualified(names.physical_namespace("auditor", F.col("ns")), F.lit("asset_lock")).alias("full_name"))


@query(" SELECT 'a.' || tbl || '.x' AS full_name, 'a' AS ns_part, tbl || '.x' AS tbl_part FROM catalog_tables")
def qualified_name_split(spark, sf_dir):
    """Split at the first dot only."""
    rows = fx.catalog_tables(spark, sf_dir).select(F.concat(F.lit("a."), F.col("tbl"), F.lit(".x")).alias("full_name"))
    ns, tbl = names.split_qualified(F.col("full_name"))
    return rows.select("full_name", ns.alias("ns_part"), tbl.alias("tbl_part"))


@query(" SELECT l_orderkey % 8 AS slice, sha256('slice-' || (l_orderkey % 8)) AS slice_id, count(*) AS n_rows FROM lineitem GROUP BY 1, 2")
def slice_ids(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(8)).alias("slice"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n_rows")).select("slice", names.slice_id(F.concat(F.lit("slice-"), F.col("slice").cast("string"))).alias("slice_id"), "n_rows")


@query(" SELECT l_orderkey % 8 AS slice, count(*) AS n_rows FROM lineitem GROUP BY 1")
def scan_slice_counts(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(8)).alias("slice"))
    return scan.slice_counts(rows, "slice")


@query(" SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_keys FROM events")
def scan_coverage_dedup(spark, sf_dir):
    """Two overlapping runs cover the table, each row once."""
    rows = fx.read(spark, sf_dir, "events").select("event_id", "user_id")
    both = audit.covered(rows.where("event_id % 3 < 2"), rows.where("event_id % 3 > 0"), "event_id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_keys"))


@query(" SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def typed_documents(spark, sf_dir):
    """Typed fields of raw documents, by a declared schema."""
    return documents.typed(fx.read(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint")


@query(
    " SELECT domain, min(ms) AS deletable_before_ms FROM (SELECT user_id % 50 AS domain, CASE WHEN event_id % 2 = 0 THEN 'ledger' ELSE 'auditor' END AS s, max(epoch_us(ts) // 1000) AS ms FROM events GROUP BY 1, 2) GROUP BY domain HAVING count(DISTINCT s) = 2"
)
def boundary_min(spark, sf_dir):
    """The boundary of each domain with both kinds of watermark."""
    rows = fx.token_table(spark, sf_dir).withColumn("domain", F.pmod("user_id", F.lit(50)))
    return watermarks.boundaries(rows)


#: Tokens and their checksums, worked out from the polynomial (2197175160 is 0x82F63B78) byte by byte.
TOKENS = """
, crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))
, issued AS (
  SELECT event_id, CASE WHEN event_id % 7 = 1 AND {ghosts} THEN 'ghost' WHEN event_id % 2 = 0 THEN 'ledger' ELSE 'auditor' END AS s,
         CASE WHEN event_id % 2 = 0 THEN 'ledger' ELSE 'auditor' END AS server, epoch_us(ts) // 1000 AS ms FROM events)
, checked AS (
  SELECT *, printf('%08x', xor(list_reduce(list_transform(string_split(s || ms, ''), lambda x: ord(x)::BIGINT),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)) AS h FROM issued, crc_table)
, told AS (SELECT *, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS crc FROM checked)
, made AS (
  SELECT *, translate(rtrim(to_base64(encode('{"server_type":"' || s || '","started_at_ms":' || ms || ',"crc32c":"'
      || CASE WHEN event_id % 7 = 2 AND {ghosts} THEN 'deadbeef0' ELSE crc END || '"}')), '='), '+/', '-_') AS good FROM told)
"""


@query(
    TOKENS.replace("{ghosts}", "true")
    + """
, given AS (
  SELECT event_id, s, ms, crc, CASE WHEN event_id % 7 = 0 THEN '!!!not-base64!!!' ELSE good END AS token,
         CASE WHEN event_id % 7 <> 3 THEN server WHEN server = 'ledger' THEN 'auditor' ELSE 'ledger' END AS expected FROM made)
, read AS (
  SELECT *, decode(TRY(from_base64(rpad(translate(token, '-_', '+/'), ((length(token) + 3) // 4 * 4)::INT, '=')))) AS j FROM given)
SELECT event_id, CASE
    WHEN j IS NULL THEN '002' WHEN j->>'server_type' NOT IN ('ledger', 'auditor') THEN '003'
    WHEN j->>'crc32c' <> crc OR (j->>'started_at_ms')::BIGINT <> ms OR j->>'server_type' <> s THEN '001'
    WHEN expected = 'ledger' AND j->>'server_type' <> 'ledger' THEN '005' WHEN expected = 'auditor' AND j->>'server_type' <> 'auditor' THEN '006'
    ELSE 'OK' END AS verdict FROM read"""
)
def token_verdicts(spark, sf_dir):
    """Verdicts on issued tokens, some of them broken, forged, of an unknown kind or in the wrong place."""
    rows = fx.token_table(spark, sf_dir)
    kind, server = F.col("event_id") % 7, F.col("server_type")
    forged = F.to_json(F.struct(server.alias("server_type"), F.col("started_at_ms"), F.lit("deadbeef0").alias("crc32c")))
    other = F.when(server == "ledger", "auditor").otherwise("ledger")
    token = (
        F.when(kind == 0, "!!!not-base64!!!")
        .when(kind == 2, tokens.base64url(F.encode(forged, "UTF-8")))
        .otherwise(tokens.encode(F.when(kind == 1, "ghost").otherwise(server), F.col("started_at_ms")))
    )
    given = rows.select("event_id", token.alias("token"), F.when(kind == 3, other).otherwise(server).alias("expected"))
    return watermarks.judged(given, "expected").select("event_id", "verdict")


@query(
    TOKENS.replace("{ghosts}", "false")
    + " SELECT event_id, good AS token, server AS server_type, ms AS started_at_ms, 'OK' AS verdict, make_timestamp(ms * 1000) AS started_at FROM made"
)
def token_round_trip(spark, sf_dir):
    """Every issued token decodes to what it was made from."""
    rows = fx.token_table(spark, sf_dir)
    made = rows.withColumn("token", tokens.encode(F.col("server_type"), F.col("started_at_ms")))
    back = watermarks.judged(made.select("event_id", "token"))
    return back.select("event_id", "token", "server_type", "started_at_ms", "verdict", times.instant(F.col("started_at_ms")).cast("timestamp_ntz").alias("started_at"))


@query(
    """, c AS (SELECT count(*) AS n_before, count(*) FILTER (tx_created_at < {G}) AS n_deleted FROM coordinator_state),
p AS (SELECT count(*) AS n_before, count(*) FILTER (registered_at < {B}) AS n_deleted FROM request_proof)
SELECT 'coordinator_state' AS tbl, n_before, n_before - n_deleted AS n_after, n_deleted, true AS agrees FROM c
UNION ALL SELECT 'request_proof', n_before, n_before - n_deleted, n_deleted, true FROM p"""
)
def reconcile_before_after(spark, sf_dir):
    """Rows before, after and deleted agree."""
    c, p = fx.coordinator_state(spark, sf_dir), fx.request_proof(spark, sf_dir)
    return audit.reconciled(
        {
            "coordinator_state": (c, retention.survivors(c, coordinator_deletable(G)), coordinator_deletable(G)),
            "request_proof": (p, retention.survivors(p, proof_deletable(B)), proof_deletable(B)),
        }
    )


@query(
    f"""{RESOLVED} SELECT 'ledger_records' AS target, count(*) AS scanned, count(*) FILTER (action NOT IN ('KEEP', 'SKIP')) AS changed, make_timestamp({{G}} * 1000) AS boundary FROM resolved
UNION ALL SELECT 'coordinator_state', count(*), count(*) FILTER (tx_created_at < {{G}}), make_timestamp({{G}} * 1000) FROM coordinator_state
UNION ALL SELECT 'request_proof', count(*), count(*) FILTER (registered_at < {{B}}), make_timestamp({{B}} * 1000) FROM request_proof
UNION ALL SELECT 'asset_lock', count(*), count(*) FILTER ({RELEASE}), make_timestamp({{B}} * 1000) FROM asset_lock"""
)
def cleanup_summary(spark, sf_dir):
    """What a whole cycle scans and changes."""
    at = lambda ms: times.instant(F.lit(ms)).cast("timestamp_ntz").alias("boundary")
    row = lambda df, name, ms, changed: df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(changed).alias("changed")).select(F.lit(name).alias("target"), "scanned", "changed", at(ms))
    out = row(_resolved(spark, sf_dir), "ledger_records", G, recovery.finalized())
    out = out.unionByName(row(fx.coordinator_state(spark, sf_dir), "coordinator_state", G, coordinator_deletable(G)))
    out = out.unionByName(row(fx.request_proof(spark, sf_dir), "request_proof", B, proof_deletable(B)))
    return out.unionByName(row(fx.asset_lock(spark, sf_dir), "asset_lock", B, needs_release(B)))


@query(" SELECT event_id, user_id, event_type FROM events")
def resumable_scan_resume(spark, sf_dir):
    """A scan that fails in its second batch and is run again delivers every row; each is taken once."""
    at = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    spec = TableSpec("events", "event_id bigint, user_id bigint, event_type string", ("event_id",), "event_id")
    fx.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").repartition(6, "event_id").write.parquet(f"{at}/in")
    write, broken = scan.write_batch(f"{at}/out"), {"once": True}

    def handler(batch: DataFrame, number: int) -> None:
        if number == 1 and broken.pop("once", False):
            raise RuntimeError("stopped on purpose")
        write(batch, number)

    try:
        scan.resumable_scan(spark, f"{at}/in", spec, handler, f"{at}/run", files_per_batch=2)
    except Exception as error:  # noqa: BLE001
        if "stopped on purpose" not in str(error):
            raise
    scan.resumable_scan(spark, f"{at}/in", spec, handler, f"{at}/run", files_per_batch=2)
    return scan.latest(spark.read.parquet(f"{at}/out"), ("event_id",)).select("event_id", "user_id", "event_type")


PARTY = "CASE WHEN substr(pk, 2)::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END"
PHYSICAL = "CASE WHEN ns = 'default' THEN 'auditor' ELSE 'auditor_' || ns END"


def _parties(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ledger's records in two tables."""
    rows, odd = fx.ledger_records(spark, sf_dir), F.substring("pk", 2, 20).cast("long") % 2
    return {"even": rows.where(odd == 0), "odd": rows.where(odd == 1)}


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the fixture's tables: two of records, a lock table for each namespace, coordinator, proofs and namespaces."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    held = fx.asset_lock(spark, sf_dir).select("ns", "id", "lock_type", "last_updated_at", "owner_nonces")
    frames = _parties(spark, sf_dir) | {jobs.COORDINATOR_TABLE: fx.coordinator_state(spark, sf_dir), jobs.PROOF_TABLE: fx.request_proof(spark, sf_dir)}
    # two namespaces beside the default one, whatever the number of locks
    frames[jobs.REGISTRY_TABLE] = held.where("ns <> 'default'").select(F.lit(0).alias("partition_id"), F.col("ns").alias("name")).distinct()
    for ns in ("default", "ns1", "ns2"):
        frames[jobs.lock_table("auditor", ns)] = held.where(F.col("ns") == ns).drop("ns")
    store.publish({name: store.stage(name, df) for name, df in frames.items()})
    return store


@query(f" SELECT {PARTY} AS full_name, count(*) AS n FROM ledger_records WHERE {CANDIDATE} GROUP BY 1")
def in_doubt_by_table(spark, sf_dir):
    """In-doubt records of all transactional tables as one relation."""
    rows = discovery.one_relation(_parties(spark, sf_dir), "tx_id", "tx_state", "tx_prepared_at")
    return rows.where(needs_finalization(G)).groupBy("full_name").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT 'ledger' || (o_orderkey % 2) AS tbl, count(*) AS n_rows FROM orders GROUP BY 1")
def catalog_targets(spark, sf_dir):
    """Transactional tables of a database of the session's catalog, and their rows."""
    db = f"ledger_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db}")
    source = f"parquet.`{sf_dir}/orders.parquet`"
    columns = "o_orderkey AS pk, CAST(o_orderkey AS STRING) AS tx_id, o_orderstatus AS tx_state, o_orderdate AS tx_prepared_at"
    for name, where in (("ledger0", "o_orderkey % 2 = 0"), ("ledger1", "o_orderkey % 2 = 1"), ("coordinator", "o_orderkey % 4 < 2")):
        spark.sql(f"CREATE VIEW {db}.{name} AS SELECT {columns} FROM {source} WHERE {where}")
    spark.sql(f"CREATE VIEW {db}.plain AS SELECT o_orderkey FROM {source}")
    found = jobs.catalog_targets(spark, f"{db}.coordinator", [db])
    rows = discovery.one_relation({t.partition(".")[2]: spark.table(t) for t in found}, "pk")
    return rows.groupBy(F.col("full_name").alias("tbl")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"{RESOLVED} SELECT {PARTY} AS full_name, pk, tx_id, tx_state, tx_prepared_at, val FROM snapshot")
def job_finalize_records(spark, sf_dir):
    """All records after the job."""
    store = _store(spark, sf_dir)
    jobs.finalize_records(spark, store, G)
    return discovery.one_relation({t: store.read(t) for t in ("even", "odd")}, "pk", "tx_id", "tx_state", "tx_prepared_at", "val")


@query(f" SELECT {PHYSICAL} AS ns, id, CASE WHEN {RELEASE} THEN 1 ELSE lock_type END AS lock_type, last_updated_at FROM asset_lock")
def job_finalize_locks(spark, sf_dir):
    """All locks of all namespaces after the job."""
    store = _store(spark, sf_dir)
    jobs.finalize_locks(spark, store, "auditor", B + LOCK_VALID_MS)
    return jobs.all_locks(store).select("ns", "id", "lock_type", "last_updated_at")


@query(" SELECT * FROM request_proof WHERE coalesce(registered_at >= {B}, true)")
def job_cleanup_proofs(spark, sf_dir):
    """Proofs that stay when the locks have been released and the job has run."""
    store = _store(spark, sf_dir)
    report = jobs.finalize_locks(spark, store, "auditor", B + LOCK_VALID_MS)
    jobs.cleanup_proofs(spark, store, report.token)
    return store.read(jobs.PROOF_TABLE)


@query(
    f" SELECT ns AS target, count(*) AS scanned, count(*) FILTER ({RELEASE}) AS changed FROM asset_lock GROUP BY 1 UNION ALL SELECT 'request_proof', count(*), count(*) FILTER (registered_at < {{B}}) FROM request_proof"
)
def job_finalize_auditor(spark, sf_dir):
    """What the job scans and changes."""
    report = jobs.finalize_auditor(spark, _store(spark, sf_dir), "auditor", B + LOCK_VALID_MS)
    return report.frame(spark).select("target", "scanned", "changed")


@query(
    f"""{RESOLVED} SELECT tx_id, c_state, tx_created_at FROM coordinator_state WHERE coalesce(tx_created_at >= {{G}}, true)
UNION ALL SELECT DISTINCT tx_id, 'ABORTED', {{G}}::BIGINT FROM resolved WHERE action LIKE 'ROLLBACK%' AND c_state IS NULL"""
)
def job_cleanup_coordinator(spark, sf_dir):
    """Coordinator rows that stay after both servers' jobs, deleted below their recorded watermarks."""
    store = _store(spark, sf_dir)
    jobs.finalize_records(spark, store, G)
    jobs.finalize_auditor(spark, store, "auditor", B + LOCK_VALID_MS)
    jobs.cleanup_coordinator(spark, store)
    return store.read(jobs.COORDINATOR_TABLE, ["tx_id", "c_state", "tx_created_at"])


@query(
    f"""{RESOLVED}, held AS (SELECT owner_nonce, min(last_updated_at) AS t FROM asset_lock WHERE lock_type = 3 AND last_updated_at < {{B}} AND NOT {RELEASE} GROUP BY 1)
SELECT 'coordinator_state' AS tbl, count(*) AS n_before, count(*) FILTER (coalesce(tx_created_at >= {{G}}, true)) AS n_after, count(*) FILTER (tx_created_at < {{G}}) AS n_deleted, true AS agrees,
  count(*) FILTER (tx_created_at < {{G}} AND tx_id IN (SELECT tx_id FROM snapshot WHERE {CANDIDATE})) AS n_unsafe FROM coordinator_state
UNION ALL SELECT 'request_proof', count(*), count(*) FILTER (coalesce(registered_at >= {{B}}, true)), count(*) FILTER (registered_at < {{B}}), true,
  count(*) FILTER (registered_at < {{B}} AND t <= registered_at) FROM request_proof LEFT JOIN held ON nonce = owner_nonce"""
)
def reconcile_safe(spark, sf_dir):
    """Rows before, after, deleted and deleted though still needed."""
    c, p, held = fx.coordinator_state(spark, sf_dir), fx.request_proof(spark, sf_dir), fx.asset_lock(spark, sf_dir)
    freed = locks.released(held, locks.expired(locks.candidates(held, B), 1))
    older, done = coordinator_deletable(G), proof_deletable(B)
    return audit.reconciled_safely(
        {
            "coordinator_state": (c, retention.survivors(c, older), older, audit.unsafe_coordinator_deletes(c, recovery.applied(_resolved(spark, sf_dir)), older, G)),
            "request_proof": (p, retention.survivors(p, done), done, audit.unsafe_proof_deletes(p, freed, done, B)),
        }
    )


@query(" SELECT count(*) FILTER (tx_created_at < {G}) AS selected, count(*) FILTER (tx_created_at < {G} AND tx_id IS NULL) AS selected_without_key, true AS failed_as_it_should FROM coordinator_state")
def guarded_deletion(spark, sf_dir):
    """Selected coordinator rows, those without key, and whether a deletion fails once there is one."""
    rows, gone = fx.coordinator_state(spark, sf_dir), coordinator_deletable(G)
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    bad = rows.where(gone).limit(1).withColumn("tx_id", F.lit(None).cast("string"))
    store.publish({jobs.COORDINATOR_TABLE: store.stage(jobs.COORDINATOR_TABLE, rows.unionByName(bad))})
    try:
        jobs.cleanup_coordinator(spark, store, watermarks.token(spark, tokens.LEDGER, G), watermarks.token(spark, tokens.AUDITOR, G))
        failed = False
    except Exception as error:  # noqa: BLE001
        failed = "no tx_id" in str(error)
    return rows.agg(F.count_if(gone).alias("selected"), F.count_if(gone & F.col("tx_id").isNull()).alias("selected_without_key")).withColumn("failed_as_it_should", F.lit(failed))


def _by_age(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the coordinator table and the proofs laid out by age."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    month = 30 * DAY_MS
    store.publish(
        {
            jobs.COORDINATOR_TABLE: store.laid_out(jobs.COORDINATOR_TABLE, fx.coordinator_state(spark, sf_dir), "tx_created_at", ("tx_id",), month),
            jobs.PROOF_TABLE: store.laid_out(jobs.PROOF_TABLE, fx.request_proof(spark, sf_dir), "registered_at", ("nonce",)),
        }
    )
    return store


@query(" SELECT tx_id, c_state, tx_created_at FROM coordinator_state WHERE coalesce(tx_created_at >= {G}, true)")
def coordinator_deleted_by_age(spark, sf_dir):
    """Coordinator rows that stay of a table laid out by age, of which only the boundary's bucket is read."""
    store = _by_age(spark, sf_dir)
    jobs.cleanup_coordinator(spark, store, watermarks.token(spark, tokens.LEDGER, G), watermarks.token(spark, tokens.AUDITOR, G))
    return store.read(jobs.COORDINATOR_TABLE)


@query(" SELECT nonce, registered_at FROM request_proof WHERE coalesce(registered_at >= {B}, true)")
def reclaimed_proofs(spark, sf_dir):
    """Proofs that are left when deletions have run and the space has been reclaimed."""
    store = _by_age(spark, sf_dir)
    jobs.cleanup_proofs(spark, store, watermarks.token(spark, tokens.AUDITOR, B))
    reclaim.reclaim(store, grace_ms=0, now_ms=int(time.time() * 1000) + 1000)
    return store.read(jobs.PROOF_TABLE)


@query(
    """, c AS (SELECT count(*) AS n, count(*) FILTER (tx_created_at < {G}) AS d FROM coordinator_state), p AS (SELECT count(*) AS n, count(*) FILTER (registered_at < {B}) AS d FROM request_proof)
SELECT 'coordinator_state' AS tbl, n AS n_before, n - d AS n_after, d AS n_deleted, true AS agrees, true AS same_content FROM c
UNION ALL SELECT 'request_proof', n, n - d, d, true, true FROM p
UNION ALL SELECT 'changed_proof', n, n - d, d, true, false FROM p"""
)
def reconcile_content(spark, sf_dir):
    """After deletions survivors are what they were; a copy in which one value differs is found out."""
    store = _by_age(spark, sf_dir)
    c, p = fx.coordinator_state(spark, sf_dir), fx.request_proof(spark, sf_dir)
    jobs.cleanup_coordinator(spark, store, watermarks.token(spark, tokens.LEDGER, G), watermarks.token(spark, tokens.AUDITOR, G))
    jobs.cleanup_proofs(spark, store, watermarks.token(spark, tokens.AUDITOR, B))
    left = store.read(jobs.PROOF_TABLE)
    least = left.agg(F.min("nonce")).first()[0]
    changed = left.withColumn("registered_at", F.when(F.col("nonce") == least, F.coalesce(F.col("registered_at"), F.lit(B)) + 1).otherwise(F.col("registered_at")))
    return audit.reconciled_content(
        {
            "coordinator_state": (c, store.read(jobs.COORDINATOR_TABLE), coordinator_deletable(G)), "request_proof": (p, left, proof_deletable(B)),
            "changed_proof": (p, changed, proof_deletable(B)),
        }
    )


@query(" SELECT event_id, user_id, event_type FROM events")
def sliced_scan_resume(spark, sf_dir):
    """Slices of a scan, of which one fails in its second page; the rerun delivers only what that slice had left."""
    at = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    spec = TableSpec("events", "event_id bigint, user_id bigint, event_type string", ("event_id",), "event_id")
    fx.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").repartition(12, "event_id").write.parquet(f"{at}/in")
    write, broken, slices = scan.write_batch(f"{at}/out"), {"once": True}, 3

    def handler(batch: DataFrame, number: int) -> None:
        if number >= slices and broken.pop("once", False):
            raise RuntimeError("stopped on purpose")
        write(batch, number)

    try:
        scan.sliced_scan(spark, f"{at}/in", spec, handler, f"{at}/run", slices, files_per_batch=1)
    except Exception as error:  # noqa: BLE001
        if "stopped on purpose" not in str(error):
            raise
    scan.sliced_scan(spark, f"{at}/in", spec, handler, f"{at}/run", slices, files_per_batch=1)
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id", "event_type")


@query(f" SELECT ns, id, 'SUCCEEDED' AS outcome, (event_id % 3 + 1)::INT AS attempt, (event_id % 3 + 1)::BIGINT AS n_asked FROM asset_lock WHERE {RELEASE}")
def lock_attempts_resumed(spark, sf_dir):
    """Locks that need up to three attempts, by a job that is stopped after the first; none is asked once more for that."""
    store, held = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), fx.asset_lock(spark, sf_dir)
    chosen = written(locks.candidates(held, B).select("ns", "id"), "attempt-locks")
    asked, event = [], F.substring("id", 6, 20).cast("long")

    def try_(rows: DataFrame, attempt: int) -> DataFrame:
        if attempt == 2 and len(asked) == 1:
            asked.append(rows.limit(0))
            raise RuntimeError("stopped on purpose")
        asked.append(rows)
        return rows.select("ns", "id", F.when(event % 3 < attempt, locks.SUCCEEDED).otherwise(locks.NOT_RECOVERABLE).alias("outcome"))

    for _ in range(2):
        try:
            done = locks.recover(chosen, try_, wait_s=0, log=jobs.StoredAttempts(store, "auditor", None))
        except RuntimeError as error:
            if "stopped on purpose" not in str(error):
                raise
    calls = reduce(DataFrame.unionByName, asked).groupBy("ns", "id").agg(F.count(F.lit(1)).alias("n_asked"))
    return done.join(calls, ["ns", "id"])


@query(f"{RESOLVED} SELECT {PARTY} AS full_name, pk, tx_state, val FROM snapshot UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END, 'late' || o_orderkey, 'COMMITTED', o_totalprice - 1 FROM orders WHERE o_orderkey % 10 < 2")
def finalized_incrementally(spark, sf_dir):
    """A second run, which looks at rows that came since the first one and at what that had left; two targets at a time."""
    store = _store(spark, sf_dir)
    jobs.finalize_records(spark, store, G, run="first", at_once=2)
    for name, rest in (("even", 0), ("odd", 1)):
        late = fx.read(spark, sf_dir, "orders").where((F.col("o_orderkey") % 10 < 2) & (F.col("o_orderkey") % 2 == rest)).select(
            F.concat(F.lit("late"), "o_orderkey").alias("pk"), F.concat(F.lit("ltx"), "o_orderkey").alias("tx_id"), F.lit("PREPARED").alias("tx_state"),
            F.lit(G - 20_000).cast("bigint").alias("tx_prepared_at"), F.col("o_totalprice").alias("val"), (F.col("o_totalprice") - 1).alias("before_val"),
        )
        store.publish({name: store.appended(name, late, store.entry(name))})
    jobs.finalize_records(spark, store, G, run="second", after="first", at_once=2)
    return discovery.one_relation({t: store.read(t) for t in ("even", "odd")}, "pk", "tx_state", "val")


def queries() -> dict:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
