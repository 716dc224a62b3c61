"""Deleting rows of immutable tables: survivors are kept by predicate or by anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def survivors(df: DataFrame, deletable: Column) -> DataFrame:
    return df.where(~deletable)


def tombstones(df: DataFrame, deletable: Column, keys: tuple[str, ...]) -> DataFrame:
    """Keys of the rows that go; a null key fails the job."""
    checked = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a selected row has no {k}"))).otherwise(F.col(k)).alias(k) for k in keys]
    return df.where(deletable).select(*checked)


def without_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key isn't among ``keys``; Spark broadcasts them when their size allows it."""
    return df.join(keys, keys.columns, "left_anti")


def counts(df: DataFrame, deletable: Column) -> DataFrame:
    """scanned, deleted and kept, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(deletable).alias("deleted"), F.count_if(~deletable).alias("kept"))
