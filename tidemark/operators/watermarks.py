"""Low watermarks: the tokens of finished runs and the boundary below which deletion is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import tokens


class BadToken(ValueError):
    """A token that a job was given is refused; the code comes first."""


def judged(table: DataFrame, expected: str | None = None) -> DataFrame:
    """The rows of a frame with a token column, with the token's fields and verdict.

    ``expected`` names the column with the server type that a token's place asks for.
    """
    want: Column | None = F.col(expected) if expected else None
    found = tokens.bound(
        tokens.decode(F.col("token")),
        lambda f: F.struct(f["server_type"].alias("server_type"), f["started_at_ms"].alias("started_at_ms"), tokens.verdict(f, want).alias("verdict")),
    )
    return table.select("*", found.alias("_token")).select(*table.columns, "_token.server_type", "_token.started_at_ms", "_token.verdict")


def boundaries(watermarks: DataFrame) -> DataFrame:
    """(domain, deletable_before_ms): the earliest start of both server types' latest runs; domains without both have none."""
    latest = watermarks.groupBy("domain", "server_type").agg(F.max("started_at_ms").alias("started_at_ms"))
    both = latest.groupBy("domain").agg(F.min("started_at_ms").alias("deletable_before_ms"), F.count_distinct("server_type").alias("n"))
    return both.where("n >= 2").select("domain", "deletable_before_ms")


def token(spark: SparkSession, server: str, started_at_ms: int) -> str:
    return spark.range(1).select(tokens.encode(F.lit(server), F.lit(started_at_ms))).first()[0]


def read_token(spark: SparkSession, text: str, expected: str) -> int:
    """The start of the run that a token stands for."""
    given = spark.createDataFrame([(text, expected)], "token string, expected string")
    row = judged(given, "expected").first()
    if row["verdict"] != tokens.OK:
        raise BadToken(f"{row['verdict']}: the {expected} token is refused")
    return row["started_at_ms"]
