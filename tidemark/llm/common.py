"""Pieces that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir, shared_table, written

__all__ = ["HOT_SHARE", "SPACE", "SPACE_CHARS", "lookup", "partitions", "shared_dir", "shared_table", "table", "words_of", "written"]

#: ASCII white space that separates words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters, for trim() and translate().
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


#: Spark's limit on the buckets of a table, as spark.sql.sources.bucketing.maxBuckets has it.
MOST_PARTS = 100_000


def partitions(spark: SparkSession, most: int = MOST_PARTS) -> int:
    """Number of parts a keyed exchange is dealt into: the session's number of shuffle partitions."""
    return max(1, min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: A key with more than this share of the rows counts as hot; so at most 1 / HOT_SHARE keys do.
HOT_SHARE = 1 / 200


def lookup(rows: DataFrame, found: DataFrame, key: str, total: int, how: str = "left", size: str = "_n") -> DataFrame:
    """Join ``rows`` to ``found``, which has one row per key and in ``size`` the key's number of rows.

    Keys with over HOT_SHARE of ``total`` rows number at most 1 / HOT_SHARE, so they are broadcast;
    the other keys are joined by a shuffle in which none of them is large. ``rows`` is read twice:
    pass a frame that is cheap to read again. Null keys match nothing and are kept by ``how="left"``.
    """
    hot_at = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(found.where(F.col(size) > hot_at).drop(size))
    cold = found.where(F.col(size) <= hot_at).drop(size)
    warm = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti")
    has_key = rest.where(F.col(key).isNotNull()).join(cold, key, how)
    out = warm.unionByName(has_key)
    if how == "left":
        out = out.unionByName(rest.where(F.col(key).isNull()), allowMissingColumns=True)
    return out
