"""Ledger tables as views over the given test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.times import epoch_ms

#: Ledger boundary (also the time of the run) and lock boundary, which fall among the tables' times.
LEDGER_MS, LOCK_MS = 915_148_810_000, 1_705_320_000_000
COORDINATOR_NAME = "america.nation_1"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def ledger_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "P", "PREPARED").when(F.col("o_orderstatus") == "O", "DELETED").otherwise("COMMITTED")
    before = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), None).otherwise(F.col("o_totalprice") - 1)
    return read(spark, sf_dir, "orders").select(
        _text("a", "o_orderkey").alias("pk"), _text("tx", "o_orderkey").alias("tx_id"), state.alias("tx_state"), epoch_ms("o_orderdate").alias("tx_prepared_at"),
        F.col("o_totalprice").alias("val"), before.alias("before_val"),
    )


def coordinator_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(key % 4 < 2).select(
        _text("tx", "o_orderkey").alias("tx_id"), F.when(key % 4 == 0, "COMMITTED").otherwise("ABORTED").alias("c_state"),
        F.when(key % 50 == 0, None).otherwise(epoch_ms("o_orderdate") + 1000).alias("tx_created_at"),
    )


def asset_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("click", "purchase"), 3).when(F.col("event_type") == "view", 2).otherwise(1)
    ns = F.when(F.col("user_id") % 3 == 0, "default").otherwise(F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")))
    return read(spark, sf_dir, "events").select(
        ns.alias("ns"), _text("asset", "event_id").alias("id"), kind.alias("lock_type"), epoch_ms("ts").alias("last_updated_at"),
        F.array(_text("n", "event_id")).alias("owner_nonces"), "event_id",
    )


def request_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        _text("n", "event_id").alias("nonce"), F.when(F.col("event_id") % 97 == 0, None).otherwise(epoch_ms("ts")).alias("registered_at")
    )


def namespace_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(
        F.when(F.col("r_regionkey") < 4, 0).otherwise(1).alias("partition_id"), F.lower("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord")
    )


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lower("r_name").alias("ns"), F.lower("n_name").alias("tbl"), (F.col("n_nationkey") % 4 != 0).alias("is_tx"), (F.col("n_nationkey") % 2 == 0).alias("completed")
    )


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, server_type, started_at_ms): tokens to be issued, one for each event."""
    server = F.when(F.col("event_id") % 2 == 0, "ledger").otherwise("auditor")
    return read(spark, sf_dir, "events").select("event_id", "user_id", server.alias("server_type"), epoch_ms("ts").alias("started_at_ms"))


#: The same views in DuckDB SQL, to be put in front of a query.
SQL = """
ledger_records AS (
  SELECT 'a' || o_orderkey AS pk, 'tx' || o_orderkey AS tx_id,
         CASE o_orderstatus WHEN 'P' THEN 'PREPARED' WHEN 'O' THEN 'DELETED' ELSE 'COMMITTED' END AS tx_state,
         epoch_ms(o_orderdate) AS tx_prepared_at, o_totalprice AS val,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice - 1 END AS before_val
  FROM orders),
coordinator_state AS (
  SELECT 'tx' || o_orderkey AS tx_id, CASE WHEN o_orderkey % 4 = 0 THEN 'COMMITTED' ELSE 'ABORTED' END AS c_state,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE epoch_ms(o_orderdate) + 1000 END AS tx_created_at
  FROM orders WHERE o_orderkey % 4 < 2),
asset_lock AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN 'default' ELSE 'ns' || (user_id % 3) END AS ns, 'asset' || event_id AS id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 3 WHEN event_type = 'view' THEN 2 ELSE 1 END AS lock_type,
         epoch_us(ts) // 1000 AS last_updated_at, 'n' || event_id AS owner_nonce, event_id
  FROM events),
request_proof AS (
  SELECT 'n' || event_id AS nonce, CASE WHEN event_id % 97 = 0 THEN NULL ELSE epoch_us(ts) // 1000 END AS registered_at FROM events),
namespace_registry AS (
  SELECT CASE WHEN r_regionkey < 4 THEN 0 ELSE 1 END AS partition_id, lower(r_name) AS name, r_regionkey::BIGINT AS ord FROM region),
catalog_tables AS (
  SELECT lower(r_name) AS ns, lower(n_name) AS tbl, n_nationkey % 4 <> 0 AS is_tx, n_nationkey % 2 = 0 AS completed
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
