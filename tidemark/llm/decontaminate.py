"""Benchmark decontamination by SimHash over item-sized windows.

A document holds an item when one of its windows, as many words long as the item, has a weighted
similarity of THRESHOLD or more to it: the shingles of five words of both, counted with repeats, share
that part of their union. Windows are found in three steps:

1. A similar window shares ``2 m t / (1 + t)`` of its m shingles with the item, so only windows with
   that many shingles of the benchmark are looked at; and it has one at least of the item's anchors, its
   rarest shingles, of which there are so many that the others alone would be too few to share.
2. The index has the items' 64-bit SimHashes in one bucket for each anchor and size. A window's SimHash is
   looked up in the buckets of its anchors; the result is all their fingerprints within RADIUS bits. In a
   bucket of over LARGE items it is found by a multi-index: the bits are cut into RADIUS + 1 blocks, of which
   one at least is equal for every fingerprint within RADIUS bits, so the union of the block lookups, checked
   by the number of differing bits, has them all. A smaller bucket is compared whole. A pair of similarity
   0.8 differs in 9.7 bits on average with a standard deviation of 2.9; RADIUS is 3.5 deviations above that.
3. The weighted similarity is computed from the words themselves.

A multi-index of all items of a size wouldn't prune: blocks of three bits have eight values, so its 21 blocks
bring up each item 2.7 times for every window. The buckets miss none either, and have a few items each.

The benchmark is taken in blocks of ITEMS items (about 1.5 kB each), each of which is broadcast and
searched against all documents in one scan; so its size is bounded by no driver or executor. Nothing is
shuffled.

Defined cases: A-Z count as lower case; null texts have no words and match nothing; items without
words are never found; items (and windows) of fewer than five words have one shingle, the whole; a
document shorter than an item is one window; repeated rows and items give repeated results; an empty
table on either side gives no matches; further columns pass through :func:`decontaminated`.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import SLICE
from tidemark.llm.common import table

SHINGLE, THRESHOLD, RADIUS, ITEMS = 5, 0.8, 20, 100_000
BLOCK_ENDS = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
#: Buckets of more items have a multi-index.
LARGE = 64
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles whose bits are summed at a time.
PIECE = 1 << 14
#: Pairs of windows and items that are compared at a time, and words of items that are kept counted.
PAIRS, COUNTED = 1 << 18, 4096
#: Bits of a shingle's hash that address the table of benchmark shingles.
ADDRESS = 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_hashes(w: list[bytes], salt: int = 0) -> np.ndarray:
    digest = partial(xxhash.xxh64_intdigest, seed=salt) if salt else xxhash.xxh64_intdigest
    return np.fromiter(map(digest, w), dtype=np.uint64, count=len(w))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * STEP
        out ^= out >> np.uint64(29)
    return out


def simhashes(shingles: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of the ``counts`` shingles from each of the ``starts``; sums are kept for PIECE shingles at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    for piece in np.unique(starts // PIECE).tolist() if len(starts) else []:
        at = np.flatnonzero(starts // PIECE == piece)
        begin, end = starts[at], starts[at] + counts[at]
        low, high = int(begin.min()), int(end.max())
        bits = np.unpackbits(shingles[low:high].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        most = 2 * (sums[end - low] - sums[begin - low]) > counts[at][:, None]
        out[at] = np.packbits(most, axis=1).view(">u8").astype(np.uint64).reshape(-1)
    return out


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def shingle_counts(w: list[bytes]) -> Counter:
    size = min(SHINGLE, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def expanded(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to before its end, and which start each belongs to."""
    count = end - start
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(np.arange(len(count)), count)


class Blocks:
    """Multi-index of fingerprints that are looked up within their bucket only."""

    def __init__(self, buckets: np.ndarray, prints: np.ndarray):
        self.prints, self.blocks = prints, []
        for block in range(RADIUS + 1):
            keys = self.keys(buckets, prints, block)
            order = np.argsort(keys, kind="stable")
            self.blocks.append((keys[order], order))

    @staticmethod
    def keys(buckets: np.ndarray, prints: np.ndarray, block: int) -> np.ndarray:
        """Bucket and block of each fingerprint in one number."""
        a, b = BLOCK_ENDS[block], BLOCK_ENDS[block + 1]
        return buckets.astype(np.uint64) << np.uint64(b - a) | prints >> np.uint64(a) & np.uint64((1 << b - a) - 1)

    def near(self, buckets: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(given, member) pairs of one bucket within RADIUS bits, by the blocks that are equal."""
        seen = []
        for block, (keys, order) in enumerate(self.blocks):
            own = self.keys(buckets, prints, block)
            entry, given = expanded(np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right"))
            member = order[entry]
            close = np.bitwise_count(prints[given] ^ self.prints[member]) <= RADIUS
            seen.append(given[close] * len(self.prints) + member[close])
        pair = np.unique(np.concatenate(seen))
        return pair // max(1, len(self.prints)), pair % max(1, len(self.prints))


class Buckets:
    """Items of one size by anchor: each anchor's bucket has the fingerprints of its items."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, prints: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.items = items[order]
        self.prints = prints[self.items]
        self.keys, self.starts, counts = np.unique(keys[order], return_index=True, return_counts=True)
        self.ends = self.starts + counts
        self.large = counts > LARGE
        entry, bucket = expanded(self.starts[self.large], self.ends[self.large])
        self.entries = entry
        self.blocks = Blocks(np.flatnonzero(self.large)[bucket], self.prints[entry]) if len(entry) else None

    def near(self, buckets: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(given, item) pairs within RADIUS bits."""
        whole = np.flatnonzero(~self.large[buckets])
        entry, given = expanded(self.starts[buckets[whole]], self.ends[buckets[whole]])
        close = np.bitwise_count(prints[whole[given]] ^ self.prints[entry]) <= RADIUS
        given, entry = whole[given[close]], entry[close]
        rest = np.flatnonzero(self.large[buckets])
        if len(rest):
            more, member = self.blocks.near(buckets[rest], prints[rest])
            given, entry = np.concatenate([given, rest[more]]), np.concatenate([entry, self.entries[member]])
        return given, self.items[entry]


class Index:
    """The items of one block of the benchmark: their shingles, and their fingerprints in buckets by size and anchor."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.texts = [b" ".join(words(t)) for _, t in items]
        self.counted: dict[int, Counter] = {}
        self.lengths = np.array([len(t.split()) for t in self.texts], dtype=np.int64)
        self.sizes = np.unique(self.lengths[self.lengths > 0])
        self.prints = np.zeros(len(items), dtype=np.uint64)
        own: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k in np.flatnonzero(self.lengths).tolist():
            size = min(SHINGLE, int(self.lengths[k]))
            hashes = shingle_hashes(word_hashes(self.texts[k].split()), size)
            own.setdefault(size, []).append((k, hashes))
            self.prints[k] = simhashes(hashes, np.array([0]), np.array([len(hashes)]))[0]
        self.known, self.table, self.buckets = {}, {}, {}
        for size, each in own.items():
            self.known[size], counts = np.unique(np.concatenate([h for _, h in each]), return_counts=True)
            self.table[size] = np.zeros(1 << ADDRESS, dtype=bool)
            self.table[size][self.known[size] >> np.uint64(64 - ADDRESS)] = True
            anchors = [self.anchors(h, counts[np.searchsorted(self.known[size], h)]) for _, h in each]
            key, item = np.concatenate(anchors), np.repeat([k for k, _ in each], [len(x) for x in anchors])
            self.buckets[size] = {n: Buckets(key[at], item[at], self.prints) for n in np.unique(self.lengths[item]).tolist() for at in [self.lengths[item] == n]}

    @staticmethod
    def anchors(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The rarest distinct shingles of an item: all the others together are fewer than a similar window shares."""
        order = np.lexsort((hashes, counts))
        return np.unique(hashes[order[: len(hashes) - int(np.ceil(THRESHOLD * len(hashes) - 1e-9)) + 1]])

    @staticmethod
    def need(a: int, b: int) -> int:
        """Least number of shared shingles of two word sequences that are similar."""
        count = lambda n: n - min(SHINGLE, n) + 1
        return int(np.ceil(THRESHOLD / (1 + THRESHOLD) * (count(a) + count(b)) - 1e-9))

    def counts(self, item: int) -> Counter:
        if item not in self.counted:
            if len(self.counted) >= COUNTED:
                self.counted.clear()
            self.counted[item] = shingle_counts(self.texts[item].split())
        return self.counted[item]

    def hits(self, w: list[bytes]):
        """By shingle length: the text's shingles, where the benchmark's are among them, and their running counts."""
        out, hashes = {}, None
        for size, h in self.known.items():
            if len(w) < size:
                continue
            hashes = word_hashes(w) if hashes is None else hashes
            grams = shingle_hashes(hashes, size)
            at = np.flatnonzero(self.table[size][grams >> np.uint64(64 - ADDRESS)])
            if len(at):
                place = np.minimum(np.searchsorted(h, grams[at]), len(h) - 1)
                at = at[h[place] == grams[at]]
                hit = np.zeros(len(grams) + 1, dtype=np.int64)
                hit[at + 1] = 1
                out[size] = (grams, at, np.cumsum(hit))
        return out

    def named(self, w: list[bytes]):
        """Windows and the buckets of their anchors, PAIRS at a time: shingles, first words, number of shingles and words, buckets and which.

        The windows are those with as many shingles of the benchmark as a similar one needs.
        """
        for size, (grams, at, sums) in self.hits(w).items():
            for n, buckets in self.buckets[size].items():
                length = min(n, len(w))
                need, m = self.need(n, length), length - size + 1
                if sums[-1] < need:
                    continue
                starts = np.flatnonzero(sums[m:] - sums[:-m] >= need)
                bucket = np.minimum(np.searchsorted(buckets.keys, grams[at]), len(buckets.keys) - 1)
                own = buckets.keys[bucket] == grams[at]
                if not len(starts) or not own.any():
                    continue
                places, bucket = at[own], bucket[own]
                order = np.argsort(bucket, kind="stable")
                places, bucket = places[order], bucket[order]
                first, last = np.searchsorted(starts, places - m + 1), np.searchsorted(starts, places, "right")
                again = np.zeros(len(places), dtype=np.int64)
                again[1:] = np.where(bucket[1:] == bucket[:-1], last[:-1], 0)
                first = np.minimum(np.maximum(first, again), last)  # windows that the same anchor has named before
                cut = np.flatnonzero(np.diff(np.cumsum(last - first) // PAIRS)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(places)]):
                    window, hit = expanded(first[a:b], last[a:b])
                    if len(window):
                        yield grams, starts[window], m, length, buckets, bucket[a:b][hit]

    @staticmethod
    def candidates(grams: np.ndarray, starts: np.ndarray, m: int, buckets: Buckets, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) pairs of the windows within RADIUS bits of an item in their buckets, in order."""
        distinct, number = np.unique(starts, return_inverse=True)
        given, items = buckets.near(which, simhashes(grams, distinct, np.full(len(distinct), m))[number])
        pairs = np.unique(np.stack([starts[given], items]), axis=1)
        return pairs[0], pairs[1]

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that the text holds."""
        w = words(text)
        if not w or not len(self.sizes):
            return []
        best: dict[int, tuple[float, int, int]] = {}
        for grams, starts, m, length, buckets, which in self.named(w):
            at, windows = -1, Counter()
            for start, item in zip(*map(np.ndarray.tolist, self.candidates(grams, starts, m, buckets, which))):
                if start != at:
                    at, windows = start, shingle_counts(w[start : start + length])
                score = similarity(windows, self.counts(item))
                if score >= THRESHOLD and (item not in best or (-score, start) < (-best[item][0], best[item][1])):
                    best[item] = (score, start, length)
        return [(i, *best[i]) for i in sorted(best)]


def blocks_of(benchmark: DataFrame, items: int = ITEMS):
    """Indexes of the benchmark's rows (item_id, text), ``items`` rows at a time."""
    rows = benchmark.select("item_id", "text").toLocalIterator()
    while block := list(islice(rows, items)):
        yield Index([(r[0], r[1]) for r in block])


def matches(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window of each item in each document."""
    spark = docs.sparkSession
    item_type = pa.string() if dict(benchmark.dtypes)["item_id"] == "string" else pa.int64()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {'string' if item_type == pa.string() else 'long'}, similarity double, first_word int, n_words int"
    out = spark.createDataFrame([], schema)

    def searcher(sent):
        def run(batches):
            index = sent.value
            for b in batches:
                rows = []
                for at in range(0, b.num_rows, SLICE):
                    part = b.slice(at, SLICE)
                    for i, t in zip(part.column(0), part.column(1)):
                        rows += [(i.as_py(), index.ids[k], score, first, n) for k, score, first, n in index.search(t.as_py())]
                columns = zip(*rows) if rows else [[]] * 5
                kinds = [b.schema.field(0).type, item_type, pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return run

    for index in blocks_of(benchmark, items):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(searcher(spark.sparkContext.broadcast(index)), schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index("text")

    def cleaner(sent):
        def run(batches):
            for b in batches:
                clean = [not sent.value.search(t.as_py()) for t in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    for index in blocks_of(benchmark, items):
        docs = docs.mapInArrow(cleaner(spark.sparkContext.broadcast(index)), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items in every whole text of ``documents``."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")
