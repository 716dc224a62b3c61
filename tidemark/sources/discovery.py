"""Which namespaces and tables a job works on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import qualified
from tidemark.schemas import DEFAULT_NAMESPACE, TRANSACTION_COLUMNS

REGISTRY_PARTITION = 0


class TooFewTargets(ValueError):
    """Fewer transactional tables were found than a ledger has."""


def namespaces(registry: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(name, ord): the default namespace, then the registered ones in the order of the registry's ``ord``, each once.

    A registry without ``ord`` has no order that outlives a rewriting of its files; its names are then in the order
    of the alphabet, all with ord zero. ``registry`` may be absent. A registered ``default`` collapses into the
    first row; null names are none.
    """
    first = spark.createDataFrame([(DEFAULT_NAMESPACE, -1)], "name string, ord long")
    if registry is None:
        return first
    listed = registry.where(F.col("partition_id") == REGISTRY_PARTITION).where(F.col("name").isNotNull())
    order = F.col("ord") if "ord" in registry.columns else F.lit(0)
    return first.union(listed.select("name", order.cast("long"))).groupBy("name").agg(F.min("ord").alias("ord"))


def catalog_tables(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """(ns, tbl, is_tx) of every table that the session's catalog lists in ``databases``, or in all."""
    rows = []
    for db in databases or [d.name for d in spark.catalog.listDatabases()]:
        for t in spark.catalog.listTables(db):
            if not t.isTemporary:
                names = {c.name for c in spark.catalog.listColumns(f"{db}.{t.name}")}
                rows.append((db, t.name, names.issuperset(TRANSACTION_COLUMNS)))
    return spark.createDataFrame(rows, "ns string, tbl string, is_tx boolean")


def targets(tables: DataFrame, coordinator: str) -> DataFrame:
    """Transactional tables other than the coordinator's, with their qualified name."""
    named = tables.withColumn("full_name", qualified(F.col("ns"), F.col("tbl")))
    return named.where(F.col("is_tx") & (F.col("full_name") != coordinator))


def pending(targets_: DataFrame, completed: DataFrame, key: str = "full_name") -> DataFrame:
    """Targets that no earlier run has completed."""
    return targets_.join(completed.select(key), key, "left_anti")


def required(found: list[str], least: int = 2) -> list[str]:
    """The targets, or an error if they are fewer than a ledger has."""
    if len(found) < least:
        raise TooFewTargets(f"{len(found)} transactional tables found; a ledger has {least} at least")
    return found


def one_relation(tables: dict[str, DataFrame], *columns: str) -> DataFrame:
    """``columns`` of several tables as one relation, with the table's name in full_name."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("full_name"), *columns) for name, df in tables.items()])
