"""Phrase collocations: frequent phrases of two to five words, scored by how much they hold together.

Counts are those of weighted acyclic automata (:mod:`tidemark.llm.transducers`). Four exchanges, each dealt by
ranges so that a task holds one range at a time:

1. A chunk of documents sends its distinct words with their counts to ranges of the words' hashes. A range sums
   them up and numbers its frequent words; rarer ones are in no frequent phrase. The chunk gets the numbers.
2. The chunk sends one count transducer of its pairs of frequent words for each *prefix range*, a range of the
   hashes of a phrase's first two words. A range unites its transducers, sums their weights, and tells the
   chunk which of its pairs are frequent.
3. The chunk sends transducers of all runs of three to five words whose pairs are all frequent. With the pairs,
   their union is the range's count transducer: every frequent phrase that begins there, with its count.
4. Of each candidate the first part is a prefix of it; the other parts are asked for in the ranges where
   they begin: the acceptor of all parts asked for is composed with the range's transducer. Single words are asked
   for at their own ranges, which also give their text. A part that has its phrase's count is dropped
   there: what lies inside any longer phrase of the same count lies inside one that is longer by one word.

What reaches a range from a chunk is summed up within the chunk, so a word, line or passage that is repeated
very often sends one path for each chunk. Scores are exact decimals; the first TOP of each language are taken
from the first TOP of each part of its phrases.

Defined cases: null texts are empty, a null language is ``und``; an empty table gives no rows; repeated
documents count each time; texts are used whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.chunks import (
    REQUEST, REQUEST_SCHEMA, answers, batches_of, by_frequency, by_range, chunked, dealt, join_blobs, pack, pack_ranks, pack_strings, range_of, ranges_of, rows_of,
    split_blobs, squeeze, tidy, unpack, unpack_ranks, unpack_strings, unsqueeze,
)
from tidemark.llm.common import lookup, partitions, shared_table, table, written
from tidemark.llm.transducers import Transducer, sort_rows, summed, united

#: A candidate's occurrences, its most words, and the phrases of each language that are returned.
LEAST, WIDTH, TOP = 100, 5, 2000
CHUNK_BYTES = 8 << 20
#: Capitals become small, and every character that ends a piece becomes a line feed.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r", bytes(range(97, 123)) + b"\n" * 9)
#: Stands for the end of a piece; no word is a full stop.
BREAK = b"."
OWN_SCHEMA = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("seq", pa.binary()), ("size", pa.int64())])
OWN = "chunk long, n long, words binary, counts binary, seq binary, size long"
#: What a range keeps of its own beside its answers, as a row of this chunk.
KEPT = -1


class _Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __init__(self, own: list[bytes], lang: bytes):
        super().__init__({BREAK: 0})
        self.own, self.lang = own, lang

    def __missing__(self, word: bytes) -> int:
        self.own.append(self.lang + b" " + word)  # a word has no blank, so the last one ends the language
        self[word] = len(self.own)
        return len(self.own)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text in small letters, with BREAK between pieces."""
    return text.translate(FOLD).replace(b"\n", b" . ").split()


def _read(batches):
    """One row per chunk: its distinct words in order of their hashes, their counts, and the sequence of their numbers."""

    def rows():
        for chunk, langs, texts in chunked(batches, CHUNK_BYTES):
            words: list[bytes] = []
            numbers: dict[str | None, _Numbers] = {}
            parts = [np.zeros(1, dtype=np.uint32)]
            for lang, text in zip(langs, texts):
                lang = "und" if lang is None else lang
                if lang not in numbers:
                    numbers[lang] = _Numbers(words, lang.encode())
                found = tokens(text)
                found.append(BREAK)
                parts.append(np.fromiter(map(numbers[lang].__getitem__, found), dtype=np.uint32, count=len(found)))
            seq = np.concatenate(parts)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
            order = np.argsort(hashes, kind="stable")
            rank = np.zeros(len(words) + 1, dtype=np.uint32)
            rank[order + 1] = np.arange(1, len(words) + 1, dtype=np.uint32)
            counts = np.bincount(seq, minlength=len(words) + 1)[1:][order]
            ranks, old = by_frequency(rank[seq], len(words) + 1)
            data = join_blobs([pack(old.astype(np.uint32)), *pack_ranks(ranks)])
            yield chunk, len(words), pack_strings([words[i] for i in order.tolist()]), pack(counts.astype(np.int64)), data, sum(map(len, texts))

    yield from batches_of(rows(), OWN_SCHEMA)
    tidy()


def _sequence(data: bytes) -> np.ndarray:
    old, *streams = split_blobs(data)
    return unpack(old, np.uint32)[unpack_ranks(streams)]


def _by_part(parts: np.ndarray):
    """(part, from, to) of the runs of equal, rising parts."""
    starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, dtype=np.int64)
    return zip(parts[starts].tolist(), starts.tolist(), np.append(starts[1:], len(parts)).tolist())


def _ask_words(ranges: int):
    def run(batches):
        def rows():
            for chunk, n, words, counts, _, _ in rows_of(batches):
                words, counts = unpack_strings(words), unpack(counts, np.int64)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
                for p, a, b in _by_part(range_of(hashes, ranges)):
                    yield p, chunk, b - a, pack_strings(words[a:b]), pack(counts[a:b])

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _number_words(ranges: int, least: int):
    """Per chunk the numbers of its words, zero for rare ones; and the range's dictionary with all occurrences of each language."""

    def run(batches):
        def rows():
            for held in by_range(batches):
                total: dict[bytes, int] = {}
                for _, _, _, data, more in held:
                    for word, n in zip(unpack_strings(data), unpack(more, np.int64).tolist()):
                        total[word] = total.get(word, 0) + n
                langs: dict[bytes, int] = {}
                for word, n in total.items():
                    lang = word.rpartition(b" ")[0]
                    langs[lang] = langs.get(lang, 0) + n
                frequent = sorted(w for w, n in total.items() if n >= least)
                part = held[0][0]
                number = {w: i * ranges + part + 1 for i, w in enumerate(frequent)}
                for _, chunk, n, data, _ in held:
                    yield part, chunk, n, pack(np.array([number.get(w, 0) for w in unpack_strings(data)], dtype=np.int64)), None
                counts = pack(np.array([total[w] for w in frequent], dtype=np.int64))
                totals = join_blobs([pack_strings(list(langs)), pack(np.array(list(langs.values()), dtype=np.int64))])
                yield part, KEPT, len(frequent), join_blobs([pack_strings(frequent), counts]), totals

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def prefix_parts(rows: np.ndarray, ranges: int) -> np.ndarray:
    """The prefix range of each row, by its first two labels."""
    h = rows[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows[:, 1].astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return range_of(h ^ (h >> np.uint64(31)), ranges).astype(np.int64)


def _by_prefix(rows: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct rows by prefix range, then as rows; and the ranges in that order."""
    parts = prefix_parts(rows, ranges)
    order = sort_rows(np.concatenate([parts[:, None], rows], axis=1))
    return order, parts[order]


class _Shard:
    """A chunk's sequence of frequent words, numbered locally from 1; zero for anything else."""

    def __init__(self, n: int, seq: bytes, found: list):
        numbers = np.zeros(n + 1, dtype=np.int64)
        at = 1
        for a in found or []:
            numbers[at : at + a["n"]] = unpack(a["data"], np.int64)
            at += a["n"]
        known, local = np.unique(numbers, return_inverse=True)
        self.labels, self.seq = known, local[_sequence(seq)].astype(np.int64)
        self.base = len(known)
        left, right = self.seq[:-1], self.seq[1:]
        self.at = np.flatnonzero((left > 0) & (right > 0))
        self.pairs, self.which, self.counts = np.unique(left[self.at] * self.base + right[self.at], return_inverse=True, return_counts=True)

    def pair_rows(self) -> np.ndarray:
        return np.stack([self.labels[self.pairs // self.base], self.labels[self.pairs % self.base]], axis=1)

    def windows(self, good: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of three to ``width`` words, as long as their pairs are ``good``, and how often each begins."""
        follows = np.zeros(len(self.seq) + width, dtype=bool)
        follows[self.at] = good[self.which]
        starts = np.flatnonzero(follows[:-1] & follows[1:])
        rows = np.zeros((len(starts), width), dtype=np.int64)
        rows[:, 0] = self.seq[starts]
        on = np.ones(len(starts), dtype=bool)
        for d in range(1, width):
            on &= follows[starts + d - 1]
            rows[on, d] = self.seq[starts[on] + d]
        rows, counts = summed(rows, np.ones(len(rows), dtype=np.int64))
        return self.labels[rows], counts


def _ask_pairs(ranges: int):
    def run(batches):
        def rows():
            for chunk, n, seq, found in rows_of(batches):
                shard = _Shard(n, seq, found)
                pairs = shard.pair_rows()
                order, parts = _by_prefix(pairs, ranges)
                pairs, counts = pairs[order], shard.counts[order]
                for p, a, b in _by_part(parts):
                    yield p, chunk, b - a, Transducer.build(pairs[a:b], counts[a:b]).to_bytes(), None

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _frequent_pairs(least: int):
    """Per chunk a bit for each of its pairs; and the range's transducer of frequent pairs."""

    def run(batches):
        def rows():
            for held in by_range(batches):
                own = [Transducer.from_bytes(data) for _, _, _, data, _ in held]
                every, total = united(own, 2)
                keep = (every[:, 1] > 0) & (total >= least)
                frequent = Transducer.build(every[keep], total[keep])
                for (part, chunk, n, _, _), shard in zip(held, own):
                    pairs, _ = shard.prefixes()
                    pairs = pairs[pairs[:, 1] > 0]  # sorted as they were sent
                    yield part, chunk, n, squeeze(np.packbits(frequent.composed(pairs[sort_rows(pairs)]) > 0).tobytes()), None
                yield held[0][0], KEPT, int(keep.sum()), frequent.to_bytes(), None

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _ask_windows(ranges: int, width: int):
    def run(batches):
        def rows():
            for chunk, n, seq, found, told in rows_of(batches):
                shard = _Shard(n, seq, found)
                order, _ = _by_prefix(shard.pair_rows(), ranges)
                good, at = np.zeros(len(order), dtype=bool), 0
                for a in told or []:
                    good[order[at : at + a["n"]]] = np.unpackbits(np.frombuffer(unsqueeze(a["data"]), np.uint8), count=a["n"])
                    at += a["n"]
                found, counts = shard.windows(good, width)
                order, parts = _by_prefix(found, ranges)
                found, counts = found[order], counts[order]
                for p, a, b in _by_part(parts):
                    yield p, chunk, b - a, Transducer.build(found[a:b], counts[a:b]).to_bytes(), None

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _frequent_phrases(least: int, width: int):
    """One row per range: its frequent phrases of two to ``width`` words with their counts."""

    def run(batches):
        def rows():
            for held in by_range(batches):
                every, total = united([Transducer.from_bytes(data) for _, chunk, _, data, _ in held if chunk != KEPT], width)
                keep = (every[:, 2] > 0) & (total >= least)
                pairs, counts = united([Transducer.from_bytes(data) for _, chunk, _, data, _ in held if chunk == KEPT], width)
                own = pairs[:, 1] > 0
                found, total = summed(np.concatenate([pairs[own], every[keep]]), np.concatenate([counts[own], total[keep]]))
                if len(found):
                    yield held[0][0], KEPT, len(found), pack_rows(found), pack(total)

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def pack_rows(rows: np.ndarray) -> bytes:
    return join_blobs([pack(rows[:, d]) for d in range(rows.shape[1])])


def unpack_rows(data: bytes) -> np.ndarray:
    return np.stack([unpack(x, np.int64) for x in split_blobs(data)], axis=1)


def _own(data: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a range, their counts and lengths."""
    rows = unpack_rows(data)
    return rows, unpack(more, np.int64), (rows > 0).sum(axis=1)


def _rests(rows: np.ndarray, lengths: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the phrases after their first ``cut`` words, two words at least; and of which phrases."""
    on = np.flatnonzero(lengths - cut >= 2)
    return np.pad(rows[on, cut:], ((0, 0), (0, cut))), on


def _ask_texts(ranges: int):
    """The words of a range's phrases, once each, at the words' ranges."""

    def run(batches):
        def rows():
            for part, _, n, data, more in rows_of(batches):
                words = np.unique(_own(data, more)[0])
                words = words[words > 0]
                order = np.argsort((words - 1) % ranges, kind="stable")
                words = words[order]
                for p, a, b in _by_part((words - 1) % ranges):
                    yield p, part, b - a, pack(words[a:b]), None

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _answer_texts(ranges: int):
    def run(batches):
        def rows():
            for held in by_range(batches):
                words, counts = [], np.zeros(0, dtype=np.int64)
                for _, chunk, _, data, _ in held:
                    if chunk == KEPT:
                        words, counts = split_blobs(data)
                        words, counts = unpack_strings(words), unpack(counts, np.int64)
                for part, chunk, n, data, _ in held:
                    if chunk != KEPT:
                        labels = unpack(data, np.int64)
                        at = (labels - 1) // ranges
                        yield part, chunk, n, join_blobs([pack(labels), pack_strings([words[i] for i in at.tolist()])]), pack(counts[at])

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _ask_parts(ranges: int, width: int):
    """The rests of a range's phrases at the ranges where they begin, each with its phrase's count where one word was cut off."""

    def run(batches):
        def rows():
            for part, _, n, data, more in rows_of(batches):
                phrases, counts, lengths = _own(data, more)
                asked, whole = [], []
                for cut in range(1, width - 1):
                    rest, on = _rests(phrases, lengths, cut)
                    asked.append(rest)
                    whole.append(counts[on] if cut == 1 else np.zeros(len(on), dtype=np.int64))
                asked, whole = np.concatenate(asked), np.concatenate(whole)
                order = sort_rows(asked)
                asked, whole = asked[order], whole[order]
                starts = np.flatnonzero(np.concatenate([[True], (asked[1:] != asked[:-1]).any(axis=1)])) if len(asked) else np.zeros(0, dtype=np.int64)
                asked, whole = asked[starts], np.maximum.reduceat(whole, starts) if len(starts) else whole
                order, parts = _by_prefix(asked, ranges)
                asked, whole = asked[order], whole[order]
                for p, a, b in _by_part(parts):
                    yield p, part, b - a, pack_rows(asked[a:b]), pack(whole[a:b])

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _answer_parts(batches):
    """Per asking range the counts of its parts; and at each range which of its own phrases a longer one swallows."""

    def rows():
        for held in by_range(batches):
            part = held[0][0]
            phrases, counts, lengths, counted = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64), None, Transducer([])
            for _, chunk, _, data, more in held:
                if chunk == KEPT:
                    phrases, counts, lengths = _own(data, more)
                    # the count of a phrase is the weight of its arc, so what follows it is taken off again
                    counted = Transducer.build(phrases, _residual(phrases, counts))
            swallowed = np.zeros(len(phrases), dtype=bool)
            number = Transducer.build(phrases, _residual(phrases, np.arange(1, len(phrases) + 1))) if len(phrases) else counted
            for _, chunk, n, data, more in held:
                if chunk != KEPT:
                    asked, whole = unpack_rows(data), unpack(more, np.int64)
                    got = counted.composed(asked)
                    gone = (whole > 0) & (100 * whole >= 100 * got)
                    swallowed[number.composed(asked[gone]) - 1] = True
                    yield part, chunk, n, pack(got), None
            if len(phrases):
                longer = lengths > 2
                first = phrases[longer].copy()
                first[np.arange(len(first)), lengths[longer] - 1] = 0
                gone = 100 * counts[longer] >= 100 * counted.composed(first)
                swallowed[number.composed(first[gone]) - 1] = True
                yield part, part, KEPT, squeeze(np.packbits(swallowed).tobytes()), None

    yield from batches_of(rows(), REQUEST_SCHEMA)
    tidy()


def _residual(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Own weights of sorted rows so that the arcs, which add up all that begins with them, get ``weights``."""
    out = weights.copy()
    for d in range(rows.shape[1] - 1, 0, -1):  # a row of d + 1 words is taken off its first d words
        at = np.flatnonzero((rows[:, d] > 0) & ((rows[:, d + 1] == 0) if d + 1 < rows.shape[1] else True))
        if not len(at):
            continue
        above = np.flatnonzero((rows[:, d] == 0) & (rows[:, d - 1] > 0))
        if not len(above):
            continue
        owner = above[np.searchsorted(above, at) - 1]
        same = (rows[owner, :d] == rows[at, :d]).all(axis=1)
        np.subtract.at(out, owner[same], weights[at[same]])
    return out


RESULT_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.list_(pa.int64())), ("r", pa.list_(pa.int64()))])
RESULT = "lang string, phrase string, a long, l array<long>, r array<long>"


def _candidates(width: int, ranges: int):
    """The candidates that stay, with the counts of both parts at each cut."""

    def run(batches):
        for part, data, more, texts, parts in rows_of(batches):
            phrases, counts, lengths = _own(data, more)
            swallowed, got = np.zeros(len(phrases), dtype=bool), {}
            for a in parts or []:
                if a["n"] == KEPT:
                    swallowed = np.unpackbits(np.frombuffer(unsqueeze(a["data"]), np.uint8), count=len(phrases)).astype(bool)
                else:
                    got[a["part"]] = unpack(a["data"], np.int64)
            word, single = {}, {}
            for a in texts:
                labels, strings = split_blobs(a["data"])
                labels = unpack(labels, np.int64).tolist()
                word.update(zip(labels, unpack_strings(strings)))
                single.update(zip(labels, unpack(a["more"], np.int64).tolist()))
            known = {tuple(r[:n]): c for r, n, c in zip(phrases.tolist(), lengths.tolist(), counts.tolist())}
            rest: dict[tuple, int] = {}
            asked = np.concatenate([_rests(phrases, lengths, cut)[0] for cut in range(1, width - 1)])
            if len(asked):
                asked = np.unique(asked, axis=0)
                order, where = _by_prefix(asked, ranges)
                asked = asked[order]
                for p, a, b in _by_part(where):
                    rest.update(zip((tuple(x for x in r if x) for r in asked[a:b].tolist()), got[p].tolist()))
            out = []
            for at in np.flatnonzero(~swallowed).tolist():
                n = int(lengths[at])
                row = tuple(phrases[at, :n].tolist())
                left = [single[row[0]], *[known[row[:k]] for k in range(2, n)]]
                right = [*[rest[row[k:]] for k in range(1, n - 1)], single[row[-1]]]
                lang = word[row[0]].rpartition(b" ")[0]
                out.append((lang.decode(), b" ".join(word[x].rpartition(b" ")[2] for x in row).decode(), int(counts[at]), left, right))
                if len(out) == 10_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
        tidy()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT_SCHEMA)], schema=RESULT_SCHEMA)


def _totals(batches):
    """(lang, n) of each range's dictionary."""
    for _, _, _, _, more in rows_of(batches):
        langs, n = split_blobs(more)
        langs = unpack_strings(langs)
        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in langs], pa.string()), pa.array(unpack(n, np.int64))], ["lang", "n"])


def _told(frame: DataFrame, name: str) -> DataFrame:
    """(chunk, answers): what the ranges have told each chunk, in order of ranges."""
    return frame.where(F.col("chunk") != KEPT).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n", "data"))).alias(name))


def phrases(docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r) of all candidates that stay, with arrays over their cuts; and (lang, n)."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    name = shared_table(spark, "collocation_chunks")
    own = docs.select("lang", "text").mapInArrow(_read, OWN)
    own.write.option("compression", "none").bucketBy(parts, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    ranges = ranges_of(chunks.agg(F.sum("size")).first()[0] or 0, parts)
    asked = chunks.mapInArrow(_ask_words(ranges), REQUEST)
    words = written(dealt(asked, parts, ranges).mapInArrow(_number_words(ranges, least), REQUEST), "collocation-words")
    numbered = chunks.select("chunk", "n", "seq").join(_told(words, "numbers"), "chunk", "left")
    asked = numbered.mapInArrow(_ask_pairs(ranges), REQUEST)
    pairs = written(dealt(asked, parts, ranges).mapInArrow(_frequent_pairs(least), REQUEST), "collocation-pairs")
    asked = numbered.join(_told(pairs, "pairs"), "chunk", "left").mapInArrow(_ask_windows(ranges, width), REQUEST)
    asked = asked.unionByName(pairs.where(F.col("chunk") == KEPT))
    found = written(dealt(asked, parts, ranges).mapInArrow(_frequent_phrases(least, width), REQUEST), "collocation-phrases")
    dictionary = words.where(F.col("chunk") == KEPT)
    texts = answers(found.mapInArrow(_ask_texts(ranges), REQUEST).unionByName(dictionary), _answer_texts(ranges), parts, ranges)
    swallowed = answers(found.mapInArrow(_ask_parts(ranges, width), REQUEST).unionByName(found), _answer_parts, parts, ranges)
    every = found.select(F.col("part").cast("long").alias("chunk"), "data", "more").join(texts.withColumnRenamed("answers", "texts"), "chunk")
    every = every.join(swallowed.withColumnRenamed("answers", "parts"), "chunk", "left")
    totals = dictionary.mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return every.mapInArrow(_candidates(width, ranges), RESULT), totals


def collocations(docs: DataFrame, least: int = LEAST, width: int = WIDTH, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found, totals = phrases(docs, least, width)
    found, totals = written(found, "collocation-candidates"), written(totals, "collocation-totals")
    tokens_ = totals.agg(F.sum("n")).first()[0] or 0
    rows = lookup(found, totals.withColumn("_n", F.col("n")), "lang", tokens_, how="inner")
    rows = rows.withColumn("_cuts", F.expr("""
        transform(l, (x, i) -> struct(
            (CAST(1000 * CAST(a AS DECIMAL(15,0)) AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST(x AS DECIMAL(19,0)) * CAST(r[i] AS DECIMAL(19,0))) AS score,
            i AS k, x AS l, r[i] AS r))"""))  # fmt: skip
    rows = rows.withColumn("_least", F.array_min("_cuts")).select("lang", "phrase", "a", "_least.l", "_least.r", "n", "_least.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same by counting all phrases.
ORACLE_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE k > 1 AND f >= 100),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.f >= 100 * c.f AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least
QUALIFY rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))
