"""The few rows of a large table whose key is among many candidates."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import written

#: Up to this many keys (about 100 bytes each) are broadcast.
BROADCAST_KEYS = 200_000
#: Size of a Bloom filter: at ten bits a key about one other row in a hundred passes.
BITS_PER_KEY, MOST_BITS = 10, 1 << 30
SETTINGS = "spark.sql.optimizer.runtime.bloomFilter."


@contextmanager
def bloom_filters(spark: SparkSession, keys: int):
    """Within it a shuffled join builds a Bloom filter of its smaller side's ``keys`` and tests it in the scan of the other."""
    bits = min(MOST_BITS, BITS_PER_KEY * keys)
    wanted = {
        SETTINGS + "enabled": "true", SETTINGS + "applicationSideScanSizeThreshold": "0", SETTINGS + "creationSideThreshold": str(1 << 40),
        SETTINGS + "expectedNumItems": str(keys), SETTINGS + "maxNumItems": str(keys), SETTINGS + "numBits": str(bits), SETTINGS + "maxNumBits": str(bits),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled(rows: DataFrame, keys: DataFrame, on: str, least) -> DataFrame:
    """The semi join for very many keys. Filters are made for sides that are themselves filtered, so the keys are, by their minimum."""
    return rows.join(keys.where(F.col(on) >= F.lit(least)), on, "left_semi")


def matching(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose ``on`` is among the ``keys``; null is no key.

    The keys are counted first. Few are broadcast; of many a Bloom filter is aggregated and tested where the rows
    are read, so that little more than the matches is shuffled. What matches many is written and read back.
    """
    keys = written(keys.select(on).where(F.col(on).isNotNull()).distinct(), "match-keys")
    told = keys.agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("least")).first()
    if told["n"] <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), on, "left_semi")
    with bloom_filters(rows.sparkSession, told["n"]):
        return written(shuffled(rows, keys, on, told["least"]), "matching")
