"""Names of namespaces, tables and slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import DEFAULT_NAMESPACE


def physical_namespace(base: str | Column, logical: Column) -> Column:
    """The base for the default namespace, else base_logical."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(logical == DEFAULT_NAMESPACE, base).otherwise(F.concat_ws("_", base, logical))


def qualified(ns: Column, table: Column) -> Column:
    return F.concat_ws(".", ns, table)


def split_qualified(name: Column) -> tuple[Column, Column]:
    """Namespace and table, split at the first dot."""
    parts = F.split(name, r"\.", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def slice_id(description: Column) -> Column:
    """Stable id of a slice: SHA-256 of its description."""
    return F.sha2(description, 256)
