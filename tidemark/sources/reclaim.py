"""Giving back the space of files that no reader needs: mark and sweep over a store's folders.

What is live is said by the pointer files. A pointer that was replaced less than the grace period ago still
counts, so a reader that took its segments within that time finds all files. The files that are there are listed
as a frame, without opening any, and joined with the segments; what belongs to no segment of a pointer that
counts, was replaced in all of them, or lies in age buckets that all of them leave out, goes. So do files that
were staged and never made live, once they are older than the grace period, which therefore must be longer than
any job. Segments that a reader has kept for longer than that must not be read any more: their rows may be gone.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import written
from tidemark.sources.snapshot import AGE, FILE, KEYLESS, StateFile, Store

GRACE_MS = 86_400_000
#: Deletions that the file system is asked for at the same time.
AT_ONCE = 16
#: Folders beside the segments: names of replaced files, and rows by file.
GONE, ROWS = "_gone", "_rows"


@dataclass
class Reclaimed:
    """Per table: files and bytes that were there, and those that went; and the number of pointer files that went."""

    tables: dict[str, dict[str, int]] = field(default_factory=dict)
    pointers: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, c["files"], c["bytes"], c["dead_files"], c["dead_bytes"]) for t, c in self.tables.items()]
        return spark.createDataFrame(rows, "tbl string, files bigint, bytes bigint, dead_files bigint, dead_bytes bigint")


def counting(pointers: list[tuple[int, int]], now_ms: int, grace_ms: int) -> list[int]:
    """The latest pointer, and those that were live at some time of the grace period."""
    replaced = [at for _, at in pointers[1:]] + [None]
    return [number for (number, _), at in zip(pointers, replaced) if at is None or at > now_ms - grace_ms]


def listed(store: Store, table: str) -> DataFrame:
    """All files below a table's folder: path, bytes, modified, at (segment), name in it, and age bucket."""
    folder = StateFile(store.spark, f"{store.root}/{table}")
    root = folder.fs.makeQualified(folder.path).toString()
    name = F.substring("path", len(root) + 2, 1 << 30)
    side = F.substring_index(name, "/", 1).isin(GONE, ROWS)
    at = F.when(side, F.substring_index(name, "/", 2)).otherwise(F.substring_index(name, "/", 1))
    found = store.files(table).select("path", "bytes", "modified", at.alias("at"), name.alias("_whole"))
    rest = F.expr("substring(_whole, length(at) + 2)")
    return found.select("path", "bytes", "modified", "at", rest.alias("name"), F.expr(f"try_cast(regexp_extract(_whole, '/{AGE}=([^/]+)/', 1) AS BIGINT)").alias("bucket"))


def _segments(store: Store, table: str, pointers: list[int]) -> DataFrame:
    """(pointer, at, since, without, gone) of the table in each pointer: a handful of rows for each."""
    rows = []
    for number in pointers:
        for s in store._load(number)[1]["tables"].get(table, []):
            rows.append((number, s["at"], s.get("since"), s["without"], s.get("gone", [])))
            rows.append((number, f"{ROWS}/{s['at']}", None, [], []))
            rows += [(number, f"{GONE}/{g}", None, [], []) for g in s.get("gone", [])]
    return store.spark.createDataFrame(rows, "pointer long, at string, since long, without array<string>, gone array<string>")


def dead_files(store: Store, table: str, pointers: list[int], before_ms: int) -> DataFrame:
    """:func:`listed` with a column dead; files modified at ``before_ms`` or later aren't dead yet."""
    files, segments = written(listed(store, table), "reclaim-files"), _segments(store, table, pointers)
    inside = files.join(F.broadcast(segments), "at").where(F.col("since").isNull() | F.col("bucket").isNull() | (F.col("bucket") >= F.col("since")) | (F.col("bucket") == KEYLESS))
    inside = inside.where(~F.array_contains("without", F.col("name")))
    named = segments.select("pointer", "at", F.explode("gone").alias("frame"))
    frames = [r["frame"] for r in named.select("frame").distinct().collect()]
    if frames:
        told = store.spark.read.schema(f"{FILE} string").parquet(*[store._path(table, GONE, f) for f in frames])
        told = told.select(F.col(FILE).alias("name"), F.regexp_extract("_metadata.file_path", f"/{GONE}/([^/]+)/", 1).alias("frame"))
        inside = inside.join(told.join(F.broadcast(named), "frame").select("pointer", "at", "name"), ["pointer", "at", "name"], "left_anti")
    live = inside.select("path").distinct().withColumn("_live", F.lit(True))
    dead = F.col("_live").isNull() & (F.col("modified") < F.timestamp_millis(F.lit(before_ms)))
    return files.join(live, "path", "left").withColumn("dead", dead).drop("_live")


def _delete(store: Store, paths, recursive: bool) -> None:
    def one(path: str) -> None:
        file = StateFile(store.spark, path)
        file.fs.delete(file.path, recursive)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for start in range(0, len(paths), 1024):
            list(pool.map(one, paths[start : start + 1024]))


def _sweep(store: Store, files: DataFrame) -> None:
    """Delete dead files; a folder of which all files are dead goes in one request."""
    folder = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    whole = F.expr("substring(path, 1, length(path) - length(name) - 1)")
    left = files
    for parent in (whole, folder):
        grouped = left.withColumn("_in", parent)
        empty = grouped.groupBy("_in").agg(F.bool_and("dead").alias("all")).where("all").select("_in")
        empty = written(empty, "reclaim-folders")
        _batches(store, empty, True)
        left = grouped.join(empty, "_in", "left_anti").drop("_in")
    _batches(store, left.where("dead").select("path"), False)


def _batches(store: Store, frame: DataFrame, recursive: bool) -> None:
    """Ask for the deletion of a frame's paths, of which the driver holds some thousand at a time."""
    held: list[str] = []
    for row in frame.toLocalIterator():
        held.append(row[0])
        if len(held) == 8192:
            _delete(store, held, recursive)
            held = []
    _delete(store, held, recursive)


def reclaim(store: Store, grace_ms: int = GRACE_MS, now_ms: int | None = None) -> Reclaimed:
    """Delete what no reader of the last ``grace_ms`` needs, in all tables of the pointers that are left."""
    now = int(time.time() * 1000) if now_ms is None else now_ms
    pointers = store.pointers()
    counted = counting(pointers, now, grace_ms)
    report = Reclaimed()
    for table in sorted({t for number, _ in pointers for t in store._load(number)[1]["tables"]}):
        files = written(dead_files(store, table, counted, now - grace_ms + 1), "reclaim-dead")
        sums = files.agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
            F.count_if("dead").alias("dead_files"), F.coalesce(F.sum(F.when(F.col("dead"), F.col("bytes"))), F.lit(0)).alias("dead_bytes"),
        )
        report.tables[table] = sums.first().asDict()
        _sweep(store, files)
    old = [number for number, _ in pointers if number not in counted]
    _delete(store, [store._state(number).path.toString() for number in old], False)
    report.pointers = len(old)
    return report
