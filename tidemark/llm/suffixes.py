"""Repeated byte strings by a distributed difference cover.

A byte goes when it lies in a string of LENGTH bytes that also starts anywhere else. The suffixes of all
texts are sampled by a difference cover: offsets whose remainder modulo PERIOD is in a set D such that
any two offsets i and j have a shift d < PERIOD for which i + d and j + d are both sampled. So if the
strings at i and j are equal, two sampled suffixes behind them share LENGTH - PERIOD + 1 bytes.

1. *Whole copies.* Texts of LENGTH bytes or more that come more than once go whole. Only the first chunk that
   has such a text takes it further, with a mark for "more than once", since parts of it may be elsewhere.
2. *Sort the sampled suffixes' prefixes and name them.* Each chunk of documents names the first
   LENGTH - PERIOD + 1 bytes of its sampled suffixes; names are sorted in their range of the name space
   and neighbours compared, which tells each chunk the names that repeat.
3. *Merge the remaining suffixes.* Offsets up to PERIOD - 1 before a repeated name are the only ones that
   can start a repeated string; all others are done. The strings of LENGTH bytes at these offsets, sampled
   or not, are named and sorted in the same way.
4. *Compare adjacent prefixes.* Equal neighbours are repeated strings, and their bytes go.

A name is a 64-bit hash, and its place in a range is its order. The names of step 3, which decide, have 61
more bits: a polynomial modulo the prime 2 ** 61 - 1 at a point that is drawn anew for each run, so two
different strings share a name with a chance of 2 ** -124, and by at most LENGTH / 2 ** 61 if they were
built to. Whole copies are told by 128 bits. Names alone are shuffled, once per chunk, so no name is hot;
texts stay in a table bucketed by chunk. Only LENGTH-byte prefixes are ever compared, so there is nothing
to recurse on below the second naming.

Defined cases: a null text is empty; texts of under LENGTH bytes keep all; strings never cross
documents; null and repeated ids keep rows of their own; an empty table gives no rows; what remains of a
text may not be valid UTF-8, so it is binary; further columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import (
    REQUEST, REQUEST_SCHEMA, answers, batches_of, by_range, chunk_table, documents_of, join_blobs, ranges_of, requests_of, rows_of, split_blobs, squeeze,
    tidy, unpack_rising, unsqueeze,
)
from tidemark.llm.common import partitions, table, written
from tidemark.llm.substrings import covered, runs

LENGTH = 400
#: PERIOD = PRIME ** 2 + PRIME + 1, and D has PRIME + 1 members.
PRIME = 13
PERIOD = PRIME * PRIME + PRIME + 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
PIECE = 1 << 20
#: Bytes of text in a chunk; a name takes some 40 bytes while it is worked on.
CHUNK_BYTES = 8 << 20


def difference_cover(prime: int) -> list[int]:
    """A perfect difference set of prime + 1 residues modulo prime ** 2 + prime + 1.

    The zeros of a linear recurrence of order three over the integers modulo ``prime`` are one when
    its polynomial is primitive up to constants; the first set that has all differences is taken.
    """
    period = prime * prime + prime + 1
    for a in range(prime):
        for b in range(prime):
            for c in range(1, prime):
                x, zeros = (0, 0, 1), []
                for i in range(period):
                    if x[0] == 0:
                        zeros.append(i)
                    x = (x[1], x[2], (a * x[2] + b * x[1] + c * x[0]) % prime)
                if len(zeros) == prime + 1 and len({(p - q) % period for p in zeros for q in zeros}) == period:
                    return zeros
    raise ValueError("no difference set was found")


def _powers(n: int) -> np.ndarray:
    """1, BASE, BASE ** 2 and so on, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), BASE, np.uint64)]), dtype=np.uint64)


_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def names(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each start (rising), worked out in pieces of bounded size."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), PIECE):
        own = starts[at : at + PIECE]
        low, high = int(own[0]), int(own[-1]) + length
        if high - low > 4 * PIECE and len(own) > 1:  # sparse starts: halve them
            half = len(own) // 2
            out[at : at + half] = names(data, own[:half], length)
            out[at + half : at + len(own)] = names(data, own[half:], length)
            continue
        n = high - low
        power = _powers(n)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data[low:high]] * power, dtype=np.uint64)])
        h = (sums[own - low + length] - sums[own - low]) * inverse[own - low]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[at : at + len(own)] = h ^ h >> np.uint64(32)
    return out


MERSENNE = np.uint64(2**61 - 1)
_LOW32, _LOW29 = np.uint64(2**32 - 1), np.uint64(2**29 - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 64 modulo 2 ** 61 - 1."""
    x = (x & MERSENNE) + (x >> np.uint64(61))
    return np.where(x >= MERSENNE, x - MERSENNE, x)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2 ** 61 - 1 of numbers below it, by halves of 32 bits."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle = _reduced(a1 * b0) + _reduced(a0 * b1)  # counts 2 ** 32 each
    middle = _reduced(middle)
    # 2 ** 64 is 8, and middle * 2 ** 32 wraps its bits above the 29th round to the lowest
    return _reduced(_reduced(a1 * b1 * np.uint64(8)) + _reduced(a0 * b0) + _reduced(((middle & _LOW29) << np.uint64(32)) + (middle >> np.uint64(29))))


class Prints:
    """Polynomials of strings modulo 2 ** 61 - 1 at a point that ``salt`` gives."""

    def __init__(self, salt: int):
        self.point = salt % (int(MERSENNE) - 2) + 2
        self.inverse = pow(self.point, -1, int(MERSENNE))

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        out, step = np.ones(1, dtype=np.uint64), x
        while len(out) < n:
            out = np.concatenate([out, multiplied(out, np.uint64(step))])
            step = step * step % int(MERSENNE)
        return out[:n]

    def of(self, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """The prints of the ``length`` bytes from each start (rising), in pieces of bounded size."""
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            end = int(np.searchsorted(starts, low + PIECE))
            own = starts[at:end]
            n = int(own[-1]) + length - low
            terms = multiplied(self._powers(self.point, n), data[low : low + n].astype(np.uint64) + np.uint64(1))
            # sums of halves don't overflow
            high, rest = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (terms >> np.uint64(32), terms & _LOW32))
            a, b = own - low, own - low + length
            high, rest = _reduced(high[b] - high[a]), _reduced(rest[b] - rest[a])
            sums = _reduced(((high & _LOW29) << np.uint64(32)) + (high >> np.uint64(29)) + rest)
            out[at:end] = multiplied(sums, self._powers(self.inverse, int(a[-1]) + 1)[a])
            at = end
        return out


class Cover:
    """The sampled offsets of texts, and what follows from their names."""

    def __init__(self, length: int, prime: int):
        self.length, self.period, self.residues = length, prime * prime + prime + 1, np.array(difference_cover(prime))
        self.named = length - self.period + 1
        if self.named < 1:
            raise ValueError("the period is longer than the strings")

    def sampled(self, size: int) -> np.ndarray:
        """Sampled offsets of a text of ``size`` bytes that have a name."""
        if size < self.length:
            return np.zeros(0, dtype=np.int64)
        rounds = np.arange(0, size, self.period)
        at = (rounds[:, None] + self.residues[None, :]).reshape(-1)
        return at[at <= size - self.named]

    def starts(self, size: int, repeated: np.ndarray) -> np.ndarray:
        """Offsets at which a repeated string can start, given the sampled offsets with a repeated name."""
        marks = np.zeros(size + 1, dtype=np.int32)
        np.add.at(marks, np.maximum(repeated - self.period + 1, 0), 1)
        np.add.at(marks, repeated + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[: size - self.length + 1] > 0)


def _order(name: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the names (with their further bits), and where in that order a new one begins."""
    order = np.argsort(name, kind="stable")
    fresh = np.ones(len(name), dtype=bool)
    fresh[1:] = np.diff(name[order]) != 0
    if other is not None and (np.diff(other[order]) != 0)[~fresh[1:]].any():  # equal names of different strings
        order = np.lexsort((other, name))
        fresh[1:] = (np.diff(name[order]) != 0) | (np.diff(other[order]) != 0)
    return order, np.flatnonzero(fresh)


class Names:
    """The distinct names of a chunk's strings, rising, which of them come more than once, and each string's number."""

    def __init__(self, found: list[np.ndarray], others: list[np.ndarray] | None, marked: list[bool]):
        """``marked`` tells for each array of names whether all of them come more than once anyway."""
        name = np.concatenate(found) if found else np.zeros(0, np.uint64)
        other = None if others is None else np.concatenate(others) if others else name
        order, starts = _order(name, other)
        sizes = np.diff(np.append(starts, len(name)))
        again = np.repeat(np.array(marked, dtype=bool), [len(f) for f in found]) if found else np.zeros(0, bool)
        self.several = (sizes > 1) | np.logical_or.reduceat(again[order], starts) if len(starts) else sizes > 1
        self.name, self.other = name[order[starts]], None if other is None else other[order[starts]]
        self.number = np.empty(len(name), dtype=np.int64)
        self.number[order] = np.repeat(np.arange(len(starts)), sizes)

    def requests(self, chunk: int, ranges: int):
        def more(a: int, b: int) -> bytes:
            blobs = [squeeze(np.packbits(self.several[a:b]).tobytes())]
            return join_blobs(blobs if self.other is None else [*blobs, self.other[a:b].tobytes()])

        return requests_of(chunk, self.name, ranges, more)

    def repeats(self, found) -> np.ndarray:
        """For each string whether it comes more than once: here, or elsewhere by the ranges' answers."""
        bits = [np.unpackbits(np.frombuffer(unsqueeze(a["data"]), np.uint8), count=a["n"]) for a in found or []]
        return (self.several | np.concatenate(bits).astype(bool) if bits else self.several)[self.number]


def _numbers(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, dtype=np.uint8) for t in texts]


def _bits(marks) -> bytes:
    return np.packbits(np.array(marks, dtype=bool)).tobytes()


def _flags(data: bytes, n: int) -> list[bool]:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool).tolist()


def _ask(ranges: int, named):
    """Requests for the names that ``named`` gives for a chunk's row."""

    def run(batches):
        yield from batches_of((r for row in rows_of(batches) for r in named(row).requests(row[0], ranges)), REQUEST_SCHEMA)
        tidy()

    return run


def _answer(batches):
    """One bit per name and chunk, whether the name comes more than once in all, and one, whether no smaller chunk has it."""

    def rows():
        for held in by_range(batches):
            chunks, sizes = np.array([r[1] for r in held]), np.array([r[2] for r in held])
            more = [split_blobs(r[4]) for r in held]
            name = np.concatenate([unpack_rising(r[3], np.uint64) for r in held])
            several = np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(m[0]), np.uint8), count=n) for m, n in zip(more, sizes.tolist())])
            other = np.concatenate([np.frombuffer(m[1], np.uint64) for m in more]) if len(more[0]) > 1 else None
            more.clear()
            order, starts = _order(name, other)
            del name, other
            counts = np.diff(np.append(starts, len(order)))
            told = np.empty(len(order), dtype=bool)
            told[order] = np.repeat((counts > 1) | (np.maximum.reduceat(several[order], starts) > 0), counts)
            rank = np.argsort(np.argsort(chunks)).astype(np.int32)
            place = np.repeat(rank, sizes)[order]
            first = np.empty(len(order), dtype=bool)
            first[order] = place == np.repeat(np.minimum.reduceat(place, starts), counts)
            ends = np.cumsum(sizes).tolist()
            for (part, chunk, n, _, _), e in zip(held, ends):
                yield part, chunk, n, squeeze(_bits(told[e - n : e])), squeeze(_bits(first[e - n : e]))

    yield from batches_of(rows(), REQUEST_SCHEMA)
    tidy()


def _whole(length: int):
    """The names of a chunk's whole texts of ``length`` bytes or more."""

    def named(row) -> Names:
        digests = [np.frombuffer(xxhash.xxh3_128_digest(t), dtype=np.uint64) for t in documents_of(*row[1:4])[1] if len(t) >= length]
        return Names([d[:1] for d in digests], [d[1:] for d in digests], [False] * len(digests))

    return named


MARKS = "chunk long, copied binary, asked binary"
MARKS_SCHEMA = pa.schema([("chunk", pa.int64()), ("copied", pa.binary()), ("asked", pa.binary())])


def _copies(length: int):
    """(chunk, copied, asked): which texts come more than once as they are, and which go on: the first of equals."""

    def run(batches):
        def rows():
            for *row, found in rows_of(batches):
                texts = documents_of(*row[1:4])[1]
                names = _whole(length)(row)
                repeats = names.repeats(found).tolist()
                bits = [np.unpackbits(np.frombuffer(unsqueeze(a["more"]), np.uint8), count=a["n"]) for a in found or []]
                first = (np.concatenate(bits)[names.number] > 0).tolist() if bits else []
                copied, asked, seen, at = [], [], set(), 0
                for t in texts:
                    long = len(t) >= length
                    copied.append(long and repeats[at])
                    asked.append(long and first[at] and int(names.number[at]) not in seen)
                    if long:
                        seen.add(int(names.number[at]))
                        at += 1
                yield row[0], _bits(copied), _bits(asked)

        yield from batches_of(rows(), MARKS_SCHEMA)
        tidy()

    return run


def _samples(row, cover: Cover) -> tuple[list[np.ndarray], list[np.ndarray], Names]:
    """Of a chunk's row with its marks: texts, sampled offsets of those that go on, and their names."""
    texts = _numbers(documents_of(*row[1:4])[1])
    copied, asked = _flags(row[4], len(texts)), _flags(row[5], len(texts))
    at = [cover.sampled(len(t)) if a else np.zeros(0, np.int64) for t, a in zip(texts, asked)]
    own = [d for d, x in enumerate(at) if len(x)]
    return texts, at, Names([names(texts[d], at[d], cover.named) for d in own], None, [copied[d] for d in own])


def _stretches(cover: Cover):
    """(chunk, stretches): from, to of the offsets of each document that can start a repeated string."""

    def run(batches):
        schema = pa.schema([("chunk", pa.int64()), ("stretches", pa.binary())])

        def rows():
            for *row, found in rows_of(batches):
                texts, samples, own = _samples(row, cover)
                repeats, end, out = own.repeats(found), 0, []
                for d, (t, at) in enumerate(zip(texts, samples)):
                    end, again = end + len(at), at[repeats[end : end + len(at)]]
                    if len(again):
                        marks = np.zeros(len(t) - cover.length + 1, dtype=bool)
                        marks[cover.starts(len(t), again)] = True
                        begin, size = runs(marks)
                        out.append(np.stack([np.full(len(begin), d), begin, begin + size]))
                data = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
                yield row[0], squeeze(data.astype(np.int64).tobytes())

        yield from batches_of(rows(), schema)
        tidy()

    return run


def _starts(row, cover: Cover, prints: Prints | None) -> tuple[list[np.ndarray], list[np.ndarray], Names]:
    """Of a chunk's row with its marks and stretches: texts, offsets that may start a repeated string, and the strings' names.

    Without ``prints`` the names have 64 bits only.
    """
    texts = _numbers(documents_of(*row[1:4])[1])
    copied = _flags(row[4], len(texts))
    d, a, b = np.frombuffer(unsqueeze(row[6]), dtype=np.int64).reshape(3, -1)
    at = [np.zeros(0, np.int64)] * len(texts)
    for k in np.unique(d).tolist():
        own = d == k
        at[k] = np.concatenate([np.arange(x, y) for x, y in zip(a[own].tolist(), b[own].tolist())])
    own = [d for d, x in enumerate(at) if len(x)]
    found = [names(texts[d], at[d], cover.length) for d in own]
    others = None if prints is None else [prints.of(texts[d], at[d], cover.length) for d in own]
    return texts, at, Names(found, others, [copied[d] for d in own])


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("n_bytes", pa.int32())]))
RESULT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:int,n_bytes:int>>"
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", SPAN)])


def _remove(cover: Cover, prints: Prints):
    def run(batches):
        def rows():
            for *row, found in rows_of(batches):
                texts, starts, own = _starts(row, cover, None)
                if found and sum(a["n"] for a in found) != len(own.name):  # strings of this chunk share 64 bits
                    texts, starts, own = _starts(row, cover, prints)
                repeats, end = own.repeats(found), 0
                del own
                ids, copied = documents_of(*row[1:4])[0], _flags(row[4], len(texts))
                for i, text, at, whole in zip(ids, texts, starts, copied):
                    end, again = end + len(at), at[repeats[end : end + len(at)]]
                    if whole:
                        yield i, len(text), len(text), b"", [{"start": 0, "n_bytes": len(text)}]
                    elif not len(again):
                        yield i, len(text), 0, text.tobytes(), []
                    else:
                        flags = np.zeros(len(text), dtype=bool)
                        flags[again] = True
                        gone = covered(flags, len(text), cover.length)
                        spans = [{"start": a, "n_bytes": n} for a, n in zip(*map(np.ndarray.tolist, runs(gone)))]
                        yield i, len(text), int(gone.sum()), text[~gone].tobytes(), spans

        yield from batches_of(rows(), RESULT_SCHEMA, 512 << 10)
        tidy()

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, prime: int = PRIME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the bytes left) and the removed spans of each document."""
    parts, cover, prints = partitions(docs.sparkSession), Cover(length, prime), Prints(uuid.uuid4().int)
    rows = chunk_table(docs.select(F.col(id_col).cast("long"), text_col), "byte_chunks", parts, CHUNK_BYTES)
    ranges = ranges_of(rows.agg(F.sum("size")).first()[0] or 0, parts)
    own = ["chunk", "n", "ids", "texts"]

    def told(frame: DataFrame, named) -> DataFrame:
        found = answers(frame.mapInArrow(_ask(ranges, named), REQUEST), _answer, parts, ranges)
        return frame.join(found, "chunk", "left").select(*frame.columns, "answers")

    marks = written(told(rows.select(*own), _whole(length)).mapInArrow(_copies(length), MARKS), "suffix-copies")
    marked = rows.join(marks, "chunk").select(*own, "copied", "asked")
    stretches = told(marked, lambda row: _samples(row, cover)[2]).mapInArrow(_stretches(cover), "chunk long, stretches binary")
    placed = marked.join(written(stretches, "suffix-stretches"), "chunk").select(*own, "copied", "asked", "stretches")
    return told(placed, lambda row: _starts(row, cover, prints)[2]).mapInArrow(_remove(cover, prints), RESULT)


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of LENGTH bytes or more in every whole text of ``documents``."""
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 400 bytes is compared with every other by its digest.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM g) WHERE n > 1),
s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM f),
k AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM s) GROUP BY r, run),
l AS (SELECT r, list(a ORDER BY a) AS al, list(b ORDER BY a) AS bl, sum(b - a) AS gone FROM k GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(al), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN al IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(al) + 1), lambda j:
    substr(h, 2 * coalesce(bl[j], 0) + 1, 2 * (coalesce(al[j + 1], length(h) // 2) - coalesce(bl[j], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN l ON d.r = l.r
"""
