"""Versioned tables: new files are written beside the old ones, then a pointer is moved.

A table is a list of segments, folders of Parquet files of which some may have been replaced by a later
segment. So a change of few rows writes only the files that hold them, and appending writes only what is
new. A table that is being read is never overwritten, and rows of several tables that must change together
become visible through one pointer. The pointer also carries the state of the run, so progress and data
can't disagree. Files are handled through Hadoop's file systems, so a root may be in any store in which
renaming is atomic and fails where the new name is taken, as HDFS has it; ``file:`` checks first and then
renames, so there two writers of the same instant aren't kept apart.

A table may be *laid out by age*: each file holds rows of one age bucket, and a small frame beside each
segment has the rows of every file. What is older than a boundary then goes without being read: the segments
are read from a later bucket on, and only the boundary's own bucket is written anew.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark.sources.shared import written

#: Up to this many replaced files of a segment are named in the pointer; more are named in a frame.
NAMED = 1_000
#: Up to this many file names (about 100 bytes each) are broadcast against a table's rows.
BROADCAST_FILES = 200_000
#: The smallest segments of a table of more segments are merged at its next change.
SEGMENTS = 64
FILE, AGE = "_file", "_age"
#: The age bucket of rows that have an age but no key.
KEYLESS = -(1 << 63)
DAY_MS = 86_400_000


class CorruptState(ValueError):
    """A pointer or state file can't be read as JSON."""


class LostUpdate(RuntimeError):
    """A table has changed since it was read for a new version."""


class StateFile:
    """A JSON file: null if absent, an error if corrupt."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def load(self) -> dict | None:
        if not self.fs.exists(self.path):
            return None
        stream = self.fs.open(self.path)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError as error:
            raise CorruptState(f"{self.path.toString()}: {error}") from error

    def create(self, state: dict) -> bool:
        """Write beside the file, then rename to it; false if the file is there already."""
        self.fs.mkdirs(self.path.getParent())
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{self.path.getParent().toString()}/.{uuid.uuid4().hex}")
        stream = self.fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.fs.getConf())
        options = self.jvm.org.apache.hadoop.fs.Options
        never_over = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.NONE.getDeclaringClass(), 1)
        never_over[0] = options.Rename.NONE
        try:
            context.rename(fresh, self.path, never_over)
        except Exception as error:  # noqa: BLE001
            self.fs.delete(fresh, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True


class Store:
    """Tables below ``root``; what is live is in the numbered pointer file with the largest number.

    A pointer file is never changed. Moving on means to create the next number, which only one of several
    writers can do; the others read again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: For work that several threads of one process must not do at the same time.
        self.lock = threading.RLock()
        #: Schemas of segments, whose files never change, so that each is looked up in a footer once.
        self._schemas: dict[tuple[str, str], StructType] = {}

    def _state(self, number: int) -> StateFile:
        # the first pointer has no number
        return StateFile(self.spark, f"{self.root}/_live/{number:012d}.json" if number else f"{self.root}/_live.json")

    def pointers(self) -> list[tuple[int, int]]:
        """(number, milliseconds at which it was created) of the pointer files that are left."""
        first = self._state(0)
        found = [(0, first.fs.getFileStatus(first.path).getModificationTime())] if first.fs.exists(first.path) else []
        folder = self._state(1).path.getParent()
        for f in first.fs.listStatus(folder) if first.fs.exists(folder) else []:
            name = f.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                found.append((int(name.removesuffix(".json")), f.getModificationTime()))
        return sorted(found)

    def _latest(self) -> int:
        return max((number for number, _ in self.pointers()), default=0)

    def _load(self, number: int | None = None) -> tuple[int, dict]:
        number = self._latest() if number is None else number
        live = self._state(number).load() or {"tables": {}, "runs": {}}
        live["tables"] = {t: self._segments(e) for t, e in live["tables"].items()}
        return number, live

    @staticmethod
    def _segments(entry: str | list[dict]) -> list[dict]:
        return [{"at": entry, "without": []}] if isinstance(entry, str) else entry

    def live(self) -> dict:
        return self._load()[1]

    def tables(self) -> list[str]:
        return sorted(self.live()["tables"])

    def exists(self, table: str) -> bool:
        return table in self.live()["tables"]

    def entry(self, table: str) -> list[dict]:
        """The segments that are live now; a reader that keeps them sees the same rows each time."""
        return self.live()["tables"][table]

    # reading

    def _path(self, table: str, *names: str) -> str:
        return "/".join([self.root, table, *names])

    @staticmethod
    def _file(s: dict) -> Column:
        """The name below its segment's folder of the file that a row is in; in a layout by age it begins with the bucket's folder."""
        return F.substring_index(F.col("_metadata.file_path"), f"/{s['at']}/", -1) if s.get("age") else F.col("_metadata.file_name")

    def _schema(self, table: str, s: dict) -> StructType:
        if s.get("schema"):  # a segment without rows has no file that would tell
            return StructType.fromJson(s["schema"])
        key = (table, s["at"])
        if key not in self._schemas:
            self._schemas[key] = self.spark.read.parquet(self._path(*key)).schema
        return self._schemas[key]

    def _gone(self, table: str, segment: dict) -> DataFrame:
        """(FILE) of the replaced files of a segment that are named in frames."""
        frames = [self.spark.read.schema(f"{FILE} string").parquet(self._path(table, "_gone", g)) for g in segment["gone"]]
        return reduce(DataFrame.unionByName, frames).distinct()

    def _segment(self, table: str, s: dict) -> DataFrame:
        """The live rows of a segment, with AGE where it is laid out by age and FILE."""
        df = self.spark.read.schema(self._schema(table, s)).parquet(self._path(table, s["at"]))
        if s.get("since") is not None:  # on the partition column alone, so older buckets aren't listed for reading
            df = df.where(F.col(AGE).isNull() | (F.col(AGE) >= s["since"]) | (F.col(AGE) == KEYLESS))
        if s["without"]:  # files are left out before they are read
            df = df.where(~self._file(s).isin(s["without"]))
        df = df.select("*", F.concat(F.lit(f"{s['at']}/"), self._file(s)).alias(FILE))
        if s.get("gone"):
            gone = self._gone(table, s).select(F.concat(F.lit(f"{s['at']}/"), FILE).alias(FILE))
            df = df.join(F.broadcast(gone) if s["n_gone"] <= BROADCAST_FILES else gone, FILE, "left_anti")
        return df

    def read(self, table: str, columns: list[str] | None = None, entry: list[dict] | None = None, files: bool = False, ages: bool = False) -> DataFrame:
        """The rows of a table; ``files`` adds the column FILE, segment and file of each row, ``ages`` the column AGE."""
        parts = []
        for s in self.entry(table) if entry is None else entry:
            df = self._segment(table, s)
            parts.append(df.drop(*[c for c, wanted in ((FILE, files), (AGE, ages)) if not wanted]))
        df = reduce(DataFrame.unionByName, parts)
        return df.select(*columns) if columns else df

    # writing

    def stage(self, table: str, df: DataFrame) -> str:
        """Write a version that isn't live yet; its name."""
        version = uuid.uuid4().hex
        df.write.parquet(self._path(table, version))
        return version

    def laid_out(self, table: str, df: DataFrame, column: str, keys: tuple[str, ...], width_ms: int = DAY_MS) -> list[dict]:
        """Segments of a version that isn't live yet, in age buckets of ``column``.

        Rows without age have a bucket of their own, and so have rows with an age of which one of ``keys`` is null.
        """
        return [self._staged(table, df, {"column": column, "keys": list(keys), "width": width_ms})]

    def _staged(self, table: str, df: DataFrame, age: dict | None) -> dict:
        """Write a segment in the layout of ``age``."""
        if age is None:
            return self._segments(self.stage(table, df))[0]
        version = uuid.uuid4().hex
        keyless = reduce(Column.__or__, [F.col(k).isNull() for k in age["keys"]], F.lit(False))
        bucket = F.floor(F.col(age["column"]) / age["width"])
        bucket = F.when(F.col(age["column"]).isNotNull() & keyless, F.lit(KEYLESS)).otherwise(bucket).cast("bigint")
        # buckets that are large go to several tasks, small ones share a task
        df.withColumn(AGE, bucket).hint("rebalance", AGE).write.partitionBy(AGE).parquet(self._path(table, version))
        schema = StructType([*df.schema.fields]).add(AGE, LongType())
        segment = {"at": version, "without": [], "age": age, "schema": json.loads(schema.json())}
        rows = self._segment(table, segment).groupBy(FILE, AGE).agg(F.count(F.lit(1)).alias("n"))  # reads footers only
        rows.write.parquet(self._path(table, "_rows", version))
        return segment

    def rows_of_files(self, table: str, entry: list[dict]) -> DataFrame:
        """(FILE, AGE, n) of the live files of a table that is laid out by age; no file of it is opened."""
        parts = []
        for s in entry:
            df = self.spark.read.schema(f"{FILE} string, {AGE} bigint, n bigint").parquet(self._path(table, "_rows", s["at"]))
            if s.get("since") is not None:
                df = df.where(F.col(AGE).isNull() | (F.col(AGE) >= s["since"]) | (F.col(AGE) == KEYLESS))
            if s["without"]:
                df = df.where(~F.substring_index(FILE, f"{s['at']}/", -1).isin(s["without"]))
            if s.get("gone"):
                df = df.join(self._gone(table, s).select(F.concat(F.lit(f"{s['at']}/"), FILE).alias(FILE)), FILE, "left_anti")
            parts.append(df)
        return reduce(DataFrame.unionByName, parts)

    def files(self, table: str) -> DataFrame:
        """(path, bytes, modified) of all Parquet files below a table's folder, live or not; none is opened."""
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        return reader.load(self._path(table)).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def _bytes(self, table: str, s: dict) -> int:
        path = StateFile(self.spark, self._path(table, s["at"]))
        return path.fs.getContentSummary(path.path).getLength()

    def _merged(self, table: str, entry: list[dict]) -> list[dict]:
        """The segments, the smallest of them written as one if they are too many."""
        if len(entry) <= SEGMENTS:
            return entry
        by_size = sorted(range(len(entry)), key=lambda i: self._bytes(table, entry[i]))
        small = set(by_size[: len(entry) - SEGMENTS // 2 + 1])
        merged = self._staged(table, self.read(table, entry=[entry[i] for i in sorted(small)]), entry[0].get("age"))
        return [*[s for i, s in enumerate(entry) if i not in small], merged]

    def appended(self, table: str, df: DataFrame, entry: list[dict]) -> list[dict]:
        """Segments with the rows of ``df`` after those of ``entry``."""
        return self._merged(table, [*entry, self._staged(table, df, entry[0].get("age"))])

    def _replaced(self, table: str, s: dict, hits: DataFrame, n: int, names: list[str] | None) -> dict | None:
        """The segment without the ``n`` files ``hits`` (FILE), also given as ``names`` where they are few; None if none of its files are left."""
        own = hits.where(F.col(FILE).startswith(f"{s['at']}/")).select(F.substring_index(FILE, f"{s['at']}/", -1).alias(FILE))
        if s.get("age"):
            none_left = self.rows_of_files(table, [s]).select(FILE).distinct().count() == n
        elif names is None:
            none_left = self._segment(table, s).select(FILE).distinct().count() == n
        else:  # the files that are named aren't opened
            none_left = self._segment(table, s).where(~self._file(s).isin(names)).isEmpty()
        if none_left:
            return None
        if names is not None and not s.get("gone") and len(s["without"]) + n <= NAMED:
            return s | {"without": sorted({*s["without"], *names})}
        if s["without"]:
            own = own.unionByName(self.spark.createDataFrame([(f,) for f in s["without"]], f"{FILE} string"))
        frame = uuid.uuid4().hex
        own.coalesce(1).write.parquet(self._path(table, "_gone", frame))  # names only
        return s | {"without": [], "gone": [*s.get("gone", []), frame], "n_gone": s.get("n_gone", 0) + len(s["without"]) + n}

    def revised(
        self, table: str, entry: list[dict], chosen: Column, change: Callable[[DataFrame], DataFrame], view: Callable[[DataFrame], DataFrame] = lambda df: df,
        narrow: dict[str, Column] | None = None,
    ) -> list[dict] | None:
        """Segments in which the files that hold ``chosen`` rows are replaced by ``change`` of their rows.

        ``view`` is what ``chosen`` and ``change`` see of the rows. None if no row is chosen. However many files
        hold chosen rows, no other file is written anew; the names of few are sent with the plan, those of many
        are joined. In the segments of ``narrow`` only rows for which its column holds are looked at.
        """
        looked = [(self._segment(table, s), (narrow or {}).get(s["at"])) for s in entry]
        rows = [view((df if only is None else df.where(only)).drop(AGE)).where(chosen).select(FILE) for df, only in looked]
        hits = written(reduce(DataFrame.unionByName, rows).distinct(), "revised-files")
        found, names = [r[0] for r in hits.limit(NAMED + 1).collect()], None
        if len(found) <= NAMED:
            each = Counter(h.partition("/")[0] for h in found)
            names = {at: [h.partition("/")[2] for h in found if h.startswith(f"{at}/")] for at in each}
        else:
            each = {r["at"]: r["n"] for r in hits.groupBy(F.substring_index(FILE, "/", 1).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if not each:
            return None
        touched = [s for s in entry if s["at"] in each]
        if names is not None:
            parts = [self._segment(table, s).where(self._file(s).isin(names[s["at"]])) for s in touched]
        else:
            n = sum(each.values())
            few = F.broadcast(hits) if n <= BROADCAST_FILES else hits
            parts = [self._segment(table, s).join(few, FILE, "left_semi") for s in touched]
        rows = reduce(DataFrame.unionByName, [p.drop(FILE, AGE) for p in parts])
        kept = [self._replaced(table, s, hits, each[s["at"]], names and names[s["at"]]) if s["at"] in each else s for s in entry]
        fresh = self._staged(table, change(view(rows)), entry[0].get("age"))
        return self._merged(table, [*[s for s in kept if s], fresh])

    def aged_out(self, table: str, entry: list[dict], boundary_ms: int, gone: Column, keyed: Column) -> tuple[list[dict] | None, int]:
        """Segments of a table laid out by age without its rows ``gone``, which are those before the boundary; and their number.

        Buckets before the boundary's own are left out without being read. Of the boundary's bucket the rows that
        stay are written anew. ``keyed`` raises for a row that is gone and has no key. None if no row is gone.
        """
        age = entry[0]["age"]
        edge = boundary_ms // age["width"]
        at = lambda bucket: self.read(table, entry=entry, ages=True).where(F.col(AGE) == bucket).drop(AGE)
        at(KEYLESS).where(gone & keyed).limit(1).collect()
        whole = self.rows_of_files(table, entry).where((F.col(AGE) < edge) & (F.col(AGE) != KEYLESS)).agg(F.sum("n")).first()[0] or 0
        n_edge = at(edge).where(gone).count()
        if not whole + n_edge:
            return None, 0
        stays = at(edge).where(~gone) if n_edge else None
        since = edge + 1 if n_edge else edge
        kept = [s | {"since": max(since, s.get("since", since))} for s in entry]
        if stays is not None and not stays.isEmpty():
            kept.append(self._staged(table, stays, age))
        left = {r[0] for r in self.rows_of_files(table, kept).select(F.substring_index(FILE, "/", 1)).distinct().collect()}
        return self._merged(table, [s for s in kept if s["at"] in left] or kept[-1:]), whole + n_edge

    # making live

    def publish(
        self, tables: dict[str, str | list[dict]], runs: dict[str, dict] | None = None, based_on: dict[str, list[dict] | None] | None = None, fresh_runs: bool = False
    ) -> None:
        """Make versions live and record runs, all in one step.

        ``based_on`` has the segments from which the new ones were made; if a table has other ones by now,
        nothing is published and the change must be made again. A run is only moved on, never replaced: what
        it has stored but for its marks of completion (its boundary above all) must be what is stored already,
        and marks that others have set stay. With ``fresh_runs`` there must be no such run yet.
        """
        while True:
            number, live = self._load()
            for table, entry in (based_on or {}).items():
                if live["tables"].get(table) != (None if entry is None else self._segments(entry)):
                    raise LostUpdate(f"{table} has changed since it was read")
            live["tables"].update({t: self._segments(e) for t, e in tables.items()})
            for run, state in (runs or {}).items():
                known = live["runs"].get(run)
                if known is not None:
                    if fresh_runs or self._identity(known) != self._identity(state):
                        raise LostUpdate(f"run {run} has been begun by another writer")
                    state = self._moved_on(known, state)
                live["runs"][run] = state
            if self._state(number + 1).create(live):
                return

    @staticmethod
    def _identity(state: dict) -> dict:
        """What a run keeps from its beginning to its end."""
        return {k: v for k, v in state.items() if k not in ("completed", "resolved")}

    @staticmethod
    def _moved_on(known: dict, state: dict) -> dict:
        """A run with the progress of both states."""
        done = state.get("completed")
        if isinstance(known.get("completed"), list):
            done = list(dict.fromkeys([*known["completed"], *done]))
            if "targets" in state:
                done = [t for t in state["targets"] if t in done]
        elif known.get("completed"):
            done = True
        resolved = (known.get("resolved") or {}) | (state.get("resolved") or {})
        return state | {"completed": done} | ({"resolved": resolved} if resolved else {})

    def run(self, name: str) -> dict | None:
        return self.live()["runs"].get(name)
