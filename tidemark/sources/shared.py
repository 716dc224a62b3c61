"""Files that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """No folder is configured that all machines of the cluster see."""


def _base(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise NoSharedFolder("spark.checkpoint.dir names no shared folder; a temporary one would be on one machine only")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def _mark(spark: SparkSession) -> str:
    """What the names of this application's folder and tables have in common."""
    return "run_" + re.sub("[^a-z0-9]+", "_", spark.sparkContext.applicationId.lower())


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's shared folder; a temporary one on a single machine that has none."""
    return f"{_base(spark).rstrip('/')}/{_mark(spark)}"


def shared_table(spark: SparkSession, label: str) -> str:
    """Name of a table of the warehouse that only this application uses."""
    return f"{label}_{_mark(spark)}_{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder and the warehouse for its own use.

    Frames that it returned lazily can't be read after that.
    """
    for table in spark.catalog.listTables():
        if _mark(spark) in table.name:
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
