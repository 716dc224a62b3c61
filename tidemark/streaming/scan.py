"""Resumable scan of a table: bounded streams whose progress survives a restart.

:func:`resumable_scan` is one stream over a table's files. :func:`sliced_scan` deals the files into slices
before it reads any, and gives each slice a stream and a position of its own: slices advance side by side, a
failed one stops no other, and a rerun repeats only what the failed slice had left.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schemas import TableSpec


@dataclass(frozen=True)
class ScanResult:
    """What this run has delivered; rows of a replayed batch count again. ``slices`` has the rows of each slice."""

    rows: int
    batches: int
    slices: dict[int, int] = field(default_factory=dict)


def resumable_scan(
    spark: SparkSession, path: str, spec: TableSpec, handler: Callable[[DataFrame, int], None], run_dir: str, files_per_batch: int = 8
) -> ScanResult:
    """Hand all files below ``path`` to ``handler`` batch by batch, from where an earlier run with ``run_dir`` stopped.

    A batch counts as done when its handler has returned, so a handler that fails sees its batch again
    under the same number: it must be idempotent per batch (:func:`write_batch` is). Rows and batch sizes
    are only known to the stream; files that arrive after the listing wait for the next run. A lost
    ``run_dir`` delivers all files again, a corrupt one fails. An empty table delivers nothing.
    """
    seen = {"rows": 0, "batches": 0}

    def each(batch: DataFrame, number: int) -> None:
        handler(batch, number)
        seen["rows"] += batch.count()  # of Parquet files only the footers are read
        seen["batches"] += 1

    stream = spark.readStream.schema(spec.struct()).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{run_dir}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return ScanResult(**seen)


#: Columns of a listing, and the most slices whose streams run at the same time.
LISTING, AT_ONCE = "path string, slice int, page long", 32


def _listing(spark: SparkSession, path: str, run_dir: str, slices: int, files_per_batch: int) -> DataFrame:
    """(path, slice, page) of a table's files, as the first run with ``run_dir`` has found and stored them.

    A page is what a slice's batch reads. Each page is a file of the listing, so a stream over a slice's part of
    the listing takes page after page.
    """
    from tidemark.sources.snapshot import StateFile  # the store isn't needed by plain scans

    at = f"{run_dir}/listing"
    done = StateFile(spark, f"{at}/_SUCCESS")
    if not done.fs.exists(done.path):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        files = reader.load(path).select("path", F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int").alias("slice"))
        place = F.row_number().over(Window.partitionBy("slice").orderBy("path"))  # of file names, not of rows
        paged = files.withColumn("page", F.floor((place - 1) / files_per_batch))
        paged.repartition("slice", "page").write.mode("overwrite").partitionBy("slice", "page").parquet(at)
    return spark.read.schema(LISTING).parquet(at)


def sliced_scan(
    spark: SparkSession, path: str, spec: TableSpec, handler: Callable[[DataFrame, int], None], run_dir: str, slices: int = 8, files_per_batch: int = 8, at_once: int = AT_ONCE
) -> ScanResult:
    """As :func:`resumable_scan`, in ``slices`` streams of which up to ``at_once`` run together.

    The listing is stored before anything is read, and a rerun uses it even if the table's files have been
    dealt anew since; files that came later wait for a scan with another ``run_dir``. The numbers that the handler
    gets are distinct over all slices, and a repeated batch has its number again. All slices are tried; the
    first failure is raised when all have ended, with the others as notes. Handlers of several slices run at
    the same time.
    """
    listing = _listing(spark, path, run_dir, slices, files_per_batch)
    found = [r["slice"] for r in listing.select("slice").distinct().orderBy("slice").collect()]  # numbers below slices
    seen = {k: [0, 0] for k in found}

    def each(slice_: int):
        def run(batch: DataFrame, number: int) -> None:
            names = [r["path"] for r in batch.select("path").orderBy("path").collect()]  # files_per_batch of them
            rows = spark.read.schema(spec.struct()).parquet(*names)
            handler(rows, number * slices + slice_)
            seen[slice_][0] += rows.count()
            seen[slice_][1] += 1

        return run

    def work(slice_: int) -> Exception | None:
        try:
            stream = spark.readStream.schema("path string, page long").option("maxFilesPerTrigger", 1).parquet(f"{run_dir}/listing/slice={slice_}")
            query = stream.writeStream.foreachBatch(each(slice_)).option("checkpointLocation", f"{run_dir}/slice-{slice_}").trigger(availableNow=True).start()
            query.awaitTermination()
        except Exception as error:  # noqa: BLE001
            return error
        return None

    with ThreadPoolExecutor(max(1, min(at_once, AT_ONCE))) as pool:
        ended = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(work), k) for k in found]]
    failed = [(k, e) for k, e in zip(found, ended) if e is not None]
    if failed:
        first = failed[0][1]
        for k, error in failed[1:]:
            first.add_note(f"slice {k}: {error}")
        raise first
    return ScanResult(sum(n for n, _ in seen.values()), sum(n for _, n in seen.values()), {k: n for k, (n, _) in seen.items()})


def write_batch(out: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own, over what an earlier try has left."""

    def handler(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return handler


def latest(rows: DataFrame, keys: tuple[str, ...], order: str = "batch") -> DataFrame:
    """One row per key, from the last batch that delivered it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def slice_counts(rows: DataFrame, slice_: str) -> DataFrame:
    """Rows of each slice; their sum is the number of rows scanned."""
    return rows.groupBy(slice_).agg(F.count(F.lit(1)).alias("n_rows"))
