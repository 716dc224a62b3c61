"""Typed rows from raw JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def typed(raw: DataFrame, column: str, schema: str | None, mode: str = "FAILFAST") -> DataFrame:
    """The frame with the fields of its JSON column in place of it; without a declared schema it is an error."""
    if not schema:
        raise ValueError("a document needs a declared schema")
    parsed = raw.withColumn("_doc", F.from_json(column, schema, {"mode": mode}))
    return parsed.select(*[c for c in raw.columns if c != column], "_doc.*")
