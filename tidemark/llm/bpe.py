"""Byte-level BPE by a global shuffle of distinct words.

Each task explodes its documents into pre-tokens with their positions and keeps, per chunk of
documents, the distinct words and the sequence of word numbers by position. The distinct words are
shuffled by word: every word meets all its occurrences in one place and is encoded once there. The
ids are joined back to the chunks, and each document is put together by position. Decoding joins
the ids to the table of token bytes, which has one row per rank of the vocabulary.

A chunk sends a word once however often it holds it, so a frequent word has one row per chunk and
no key is hot. The vocabulary (its size is fixed by the rank file) is all that is broadcast.

Defined cases: a null text is empty and has no tokens; the empty text encodes to no ids; null and
repeated document ids keep a row of their own; an empty table gives no rows; further columns of the
documents are ignored.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import (
    batches_of, by_frequency, chunked, gather, join_blobs, pack, pack_ids, pack_ranks, pack_rising, pack_strings,
    rows_of, split_blobs, tidy, unpack, unpack_ids, unpack_ranks, unpack_rising, unpack_strings,
)
from tidemark.llm.common import partitions, table

HOP = "key int, chunk long, part int, n int, data binary, more binary"
HOP_SCHEMA = pa.schema([("key", pa.int32()), ("chunk", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
#: The part of the row that has a chunk's own documents; it sorts before the answers.
OWN = -1
#: Encoded words that a task remembers; beyond that it starts anew, so its memory is bounded whatever its part of the words.
KNOWN = 1 << 20
#: Parts that words are dealt into at most: a chunk has a row for each, which should hold more than a handful of words.
MOST_WORD_PARTS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _explode(pattern: str, parts: int):
    """Documents to one row with the word numbers by position and, for each part, the chunk's distinct words."""

    def run(batches):
        split = regex.compile(pattern).findall

        def rows():
            for chunk, ids, texts in chunked(batches):
                numbers: dict[str, int] = {}
                sequences = []
                for text in texts:
                    words = split(text.decode())
                    for w in words:
                        if w not in numbers:
                            numbers[w] = len(numbers)
                    sequences.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                lengths = np.array([len(s) for s in sequences], dtype=np.uint32)
                ranks, order = by_frequency(np.concatenate(sequences), len(numbers))
                yield (chunk + (chunk >> 32)) % 2**32 % parts, chunk, OWN, len(ids), join_blobs(pack_ranks(ranks)), join_blobs([pack(lengths), pack_ids(ids)])
                words = list(numbers)
                words = [words[i].encode() for i in order.tolist()]
                where = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % parts
                order = np.argsort(where, kind="stable")
                ends = np.searchsorted(where[order], np.arange(parts + 1))
                for p in range(parts):
                    own = order[ends[p] : ends[p + 1]]
                    if len(own):
                        yield p, chunk, p, len(own), pack_strings([words[i] for i in own.tolist()]), pack_rising(own.astype(np.uint32))

        yield from batches_of(rows(), HOP_SCHEMA)
        tidy()

    return run


def _encode(ranks, pattern: str):
    """Each distinct word of a part is encoded once; every chunk that sent it gets its ids."""

    def run(batches):
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, tuple[int, ...]] = {}

        def rows():
            for key, chunk, part, n, data, more in rows_of(batches):
                if part != OWN:
                    found = []
                    for w in unpack_strings(data):
                        ids = known.get(w)
                        if ids is None:
                            if len(known) >= KNOWN:
                                known.clear()
                            ids = known[w] = tuple(encoding.encode_ordinary(w.decode()))
                        found.append(ids)
                    lengths = np.fromiter(map(len, found), dtype=np.uint32, count=n)
                    flat = np.fromiter((i for ids in found for i in ids), dtype=np.uint32)
                    data, more = pack(flat), join_blobs([pack(lengths), more])
                yield key, chunk, part, n, data, more

        yield from batches_of(rows(), HOP_SCHEMA)
        tidy()

    return run


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reassemble(batches):
    """Rows sorted by chunk and part to the ids of each document."""

    def documents(own, answers):
        _, _, _, n, data, more = own
        lengths, ids = split_blobs(more)
        words, ids = unpack_ranks(split_blobs(data)), unpack_ids(ids, n)
        total = sum(a[3] for a in answers)
        starts, sizes, flats, at = np.zeros(total, np.int64), np.zeros(total, np.int64), [], 0
        for _, _, _, _, tokens, places in answers:
            size, places = split_blobs(places)
            size, tokens, places = unpack(size, np.uint32).astype(np.int64), unpack(tokens, np.uint32), unpack_rising(places, np.uint32)
            sizes[places] = size
            starts[places] = at + np.cumsum(size) - size
            flats.append(tokens)
            at += len(tokens)
        flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
        end = 0
        for i, k in zip(ids, unpack(lengths, np.uint32).tolist()):
            at, end = end, end + k
            w = words[at:end]
            tokens = gather(flat, starts[w], sizes[w])
            yield i, len(tokens), tokens.astype("<u4").tobytes()

    def rows():
        own, answers = None, []
        for r in rows_of(batches):
            if r[2] == OWN:
                if own is not None:
                    yield from documents(own, answers)
                own, answers = r, []
            else:
                answers.append(r)
        if own is not None:
            yield from documents(own, answers)

    yield from batches_of(rows(), ENCODED)
    tidy()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, see :func:`as_array`)."""
    spark = docs.sparkSession
    words = partitions(spark, MOST_WORD_PARTS)
    sent = spark.sparkContext.broadcast(ranks)
    asked = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(_explode(pattern, words), HOP)
    answered = asked.repartitionById(words, F.col("key")).mapInArrow(_encode(sent, pattern), HOP)
    return answered.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk", "part").mapInArrow(_reassemble, "doc_id long, n_tokens long, ids binary")


def as_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the bytes of its ids; an id outside the vocabulary is an error."""
    size = max(ranks.values(), default=-1) + 1
    tokens: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    sent = encoded.sparkSession.sparkContext.broadcast(tokens)
    names = encoded.columns
    at = names.index("ids")

    def run(batches):
        column = pa.array(sent.value, pa.binary())
        for b in batches:
            out = []
            for ids in b.column(at).to_pylist():
                found = column.take(pa.array(as_array(ids or b"")))
                if found.null_count:
                    raise ValueError("an id has no token")
                ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1] if len(found) else [0]
                out.append(found.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if len(found) else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, "decoded"])
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return decode(encode(docs, ranks, pattern), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def public_ranks() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text of ``documents`` and decode the ids."""
    return round_trip(table(spark, sf_dir, "documents"), *public_ranks())
