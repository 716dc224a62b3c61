"""Packing of a task's rows into few large ones, so that a shuffle moves numbers and not row overhead.

A *chunk* is a run of documents that one task has read, bounded by the bytes of their texts. What a
chunk asks of the whole corpus is dealt by hash into *ranges*; each range answers each chunk, and the
answers meet the chunk's own rows again at the chunk's key. The number of ranges follows the bytes of all
texts, so a task, which takes its ranges one after the other, needs the same memory at any size.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_table

LIBC = ctypes.CDLL(None)
#: Bytes of text in a chunk; a longer document is a chunk by itself.
CHUNK_BYTES = 12 << 20
#: Rows of an Arrow batch that are turned into Python values at a time.
SLICE = 256
#: Numbers of one byte, and of two, in :func:`pack_ranks`.
ONE, TWO = 192, 48 << 8


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers with the bytes of equal weight together."""
    a = np.ascontiguousarray(numbers)
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(unsqueeze(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def by_frequency(numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers with the most frequent of 0..n-1 called 0, and so on; and the old number of each new one."""
    order = np.argsort(-np.bincount(numbers, minlength=n), kind="stable")
    rank = np.empty(n, dtype=np.uint32)
    rank[order] = np.arange(n, dtype=np.uint32)
    return rank[numbers], order


def pack_ranks(ranks: np.ndarray) -> list[bytes]:
    """Ranks of which most are small: streams of first, second and further bytes."""
    ranks = ranks.astype(np.uint32)
    rest = ranks - np.uint32(ONE)
    two, more = (ranks >= ONE) & (rest < TWO), (ranks >= ONE) & (rest >= TWO)
    lead = np.where(two, ONE + (rest >> 8), np.where(more, 255, ranks)).astype(np.uint8)
    return [squeeze(lead.tobytes(), 6), squeeze((rest[two] & 255).astype(np.uint8).tobytes(), 3), pack(rest[more])]


def unpack_ranks(streams: list[bytes]) -> np.ndarray:
    lead = np.frombuffer(unsqueeze(streams[0]), dtype=np.uint8).astype(np.uint32)
    second, rest = np.frombuffer(unsqueeze(streams[1]), dtype=np.uint8), unpack(streams[2], np.uint32)
    two, more = (lead >= ONE) & (lead < 255), lead == 255
    lead[two] = ONE + ((lead[two] - ONE) << 8) + second
    lead[more] = rest + np.uint32(ONE)
    return lead


def pack_rising(numbers: np.ndarray) -> bytes:
    """Numbers that never fall, by their differences."""
    return pack(np.diff(numbers, prepend=numbers[:1] * 0))


def unpack_rising(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def pack_strings(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), dtype=np.uint32, count=len(items))
    return squeeze(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items))


def unpack_strings(data: bytes) -> list[bytes]:
    data = unsqueeze(data)
    n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
    ends = np.cumsum(np.frombuffer(data, dtype=np.uint32, count=n, offset=4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]).tolist() if n else []
    return [data[a:b] for a, b in zip(starts, ends.tolist())]


def pack_ids(ids: list) -> bytes:
    """Document ids, nulls among them."""
    known = np.array([i is not None for i in ids], dtype=bool)
    return squeeze(np.packbits(known).tobytes() + np.array([i or 0 for i in ids], dtype=np.int64).tobytes())


def unpack_ids(data: bytes, n: int) -> list:
    data, head = unsqueeze(data), -(-n // 8)
    known = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=head), count=n).tolist()
    return [i if k else None for i, k in zip(np.frombuffer(data, dtype=np.int64, offset=head).tolist(), known)]


def chunked(batches, limit: int = CHUNK_BYTES):
    """(chunk number, ids, texts as bytes) of the rows (id, text) that a task reads; null texts are empty."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    ids, texts, size = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                t = t.encode() if t else b""
                if texts and size + len(t) > limit:
                    yield number, ids, texts
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
    if texts:
        yield number, ids, texts


def rows_of(batches):
    """The rows of Arrow batches as tuples; only one row is copied at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def batches_of(rows, schema: pa.Schema, limit: int = 4 << 20):
    """Arrow batches of about ``limit`` bytes of binary values each."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, (bytes, memoryview)))
        if size > limit:
            yield batch_of(held, schema)
            held, size = [], 0
    if held:
        yield batch_of(held, schema)


def join_blobs(blobs: list[bytes]) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], dtype=np.uint32).tobytes() + b"".join(blobs)


def split_blobs(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
    out, at = [], 4 + 4 * n
    for size in np.frombuffer(data, dtype=np.uint32, count=n, offset=4).tolist():
        out.append(data[at : at + size])
        at += size
    return out


def tidy() -> None:
    """Give a finished task's freed memory back: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + length], one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


TABLE_SCHEMA = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("texts", pa.binary()), ("size", pa.int64())])
REQUEST = "part int, chunk long, n int, data binary, more binary"
REQUEST_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])


def _collect(limit: int):
    def run(batches):
        rows = ((chunk, len(ids), pack_ids(ids), squeeze(join_blobs(texts), 3), sum(map(len, texts))) for chunk, ids, texts in chunked(batches, limit))
        yield from batches_of(rows, TABLE_SCHEMA)
        tidy()

    return run


def chunk_table(docs: DataFrame, label: str, parts: int, limit: int = CHUNK_BYTES) -> DataFrame:
    """The documents (id, text) as one row per chunk, in a table of the warehouse bucketed by chunk.

    Later joins on the chunk find the texts where they are: only what is asked and answered is shuffled.
    """
    spark = docs.sparkSession
    name = shared_table(spark, label)
    rows = docs.mapInArrow(_collect(limit), "chunk long, n int, ids binary, texts binary, size long")
    # the blobs are compressed already
    rows.write.option("compression", "none").bucketBy(parts, "chunk").saveAsTable(name)
    return spark.table(name)


def documents_of(n: int, ids: bytes, texts: bytes) -> tuple[list, list[bytes]]:
    return unpack_ids(ids, n), split_blobs(unsqueeze(texts))


#: Bytes of text whose requests make a range, what a task holds at a time.
RANGE_BYTES = 16 << 20
#: So many ranges at most: with more, a chunk's request to a range would be a handful of names.
MOST_RANGES = 16_384


def ranges_of(text_bytes: int, parts: int) -> int:
    """Ranges of the hash space that requests are dealt into, by the bytes of all texts."""
    return min(MOST_RANGES, max(parts, -(-text_bytes // RANGE_BYTES)))


def dealt(requests: DataFrame, parts: int, ranges: int) -> DataFrame:
    """The requests in up to ``parts`` tasks, each of which gets its ranges in order and so can hold one at a time."""
    parts = min(parts, ranges)
    return requests.repartitionById(parts, F.expr(f"CAST(CAST(part AS BIGINT) * {parts} DIV {ranges} AS INT)")).sortWithinPartitions("part")


def answers(requests: DataFrame, answer, parts: int, ranges: int) -> DataFrame:
    """(chunk, answers): what ``answer`` yields for the requests of each range, gathered by chunk, in order of ranges.

    There is one answer for each range at most, so a chunk's list is bounded by the chunk.
    """
    found = dealt(requests, parts, ranges).mapInArrow(answer, REQUEST)
    return found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n", "data", "more"))).alias("answers"))


def by_range(batches):
    """The requests of one range after the other, as lists."""
    held: list[tuple] = []
    for r in rows_of(batches):
        if held and held[0][0] != r[0]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; rises with the hash."""
    return (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def requests_of(chunk: int, hashes: np.ndarray, ranges: int, more):
    """One request for each range of the rising ``hashes``; ``more(from, to)`` is what goes with them."""
    own, starts = np.unique(range_of(hashes, ranges), return_index=True)
    for p, a, b in zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
        yield p, chunk, b - a, pack_rising(hashes[a:b]), more(a, b)
