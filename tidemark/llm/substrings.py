"""Repeated word spans: token k-mers as the edges of a De Bruijn graph, compacted to paths.

1. Every window of K consecutive words is an edge between the runs of its first and its last K - 1 words.
   A chunk of documents sends each edge it holds once, with the place where it comes first (smallest
   document, first word), to the range of the graph that the edge's hash falls in. The range answers where
   the edge comes first of all, if that is in a smaller document than the chunk's own.
2. Edges of a document that repeat, and that follow each other both there and at their first places, are
   packed to pieces of paths: where a path branches, the first places stop following each other. A piece is
   one row: its own coordinates, those of its source, and a 128-bit hash of its words. Pieces are cut at
   every BLOCK-th word of the source, so that pieces of documents that share a passage are equal.
3. Pieces are joined in Spark to the chunks of their sources. The distinct claims (source coordinates, length
   and words) are checked against the words that are there; only verified pieces are joined back.
4. Verified pieces compact to nonbranching paths by a join of the end of each with the start of the next.
5. A document's paths are joined to its chunk, and the words that they cover go.

An edge is sent once per chunk and a claim is checked once, however many copies hold them, so neither is hot;
claims with very many pieces are joined by broadcast, of which there are at most 1 / HOT_SHARE. Texts stay in
a table bucketed by chunk and are never shuffled.

Edges are found by 64-bit hashes of 64-bit word hashes, and words go only if they are those of the source.
A piece that isn't verified is cut to its edges and they are checked: where documents share an id, edges may follow
each other at that id's coordinates that no one document holds together. An edge that still isn't verified has the
hash of another; then all edges are looked up again under other hashes, and the results of both count, until
every edge is verified.

Defined cases: a null text has no words; documents of under K words keep all; a null id counts as
larger than any other and is the source of no removal; rows with the same id aren't smaller than each
other; an empty table gives no rows; texts are used whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.chunks import (
    REQUEST, REQUEST_SCHEMA, answers, batches_of, by_range, chunk_table, documents_of, join_blobs, pack, ranges_of, requests_of, rows_of, split_blobs,
    squeeze, tidy, unpack, unpack_ids, unpack_rising, unsqueeze,
)
from tidemark.llm.common import lookup, partitions, table, written
from tidemark.llm.decontaminate import shingle_hashes, word_hashes

K = 13
LAST = np.iinfo(np.int64).max
#: Bytes of text in a chunk; an edge takes about ten times the bytes of its word while it is worked on.
CHUNK_BYTES = 8 << 20
#: Words of a source between the places where pieces of paths are cut.
BLOCK = 1024
#: Claims on one chunk that a task checks at a time.
CLAIMS = 20_000
SPAN = "first_word:int,n_words:int,source:bigint,source_word:int"
RESULT = f"doc_id long, n_words long, n_removed long, kept string, spans array<struct<{SPAN}>>"
SPAN_TYPE = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_word", pa.int32())]))
RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", SPAN_TYPE)])
PATH = "chunk long, row int, first_word int, n_words int, source long, source_word int, content binary"
PATH_SCHEMA = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_word", pa.int32()), ("content", pa.binary())])


class Edges:
    """The edges of a chunk's documents in order of the documents' ids, and their distinct hashes with first places."""

    def __init__(self, ids: list, texts: list[bytes], k: int, salt: int = 0):
        keys = np.array([LAST if i is None else i for i in ids], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        hashes = [shingle_hashes(word_hashes(texts[d].split(), salt), k) for d in self.order.tolist()]
        self.counts = np.array([len(h) for h in hashes], dtype=np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        hashes.clear()
        self.docs = np.repeat(keys[self.order], self.counts)
        self.distinct, first, self.inverse = np.unique(every, return_index=True, return_inverse=True)
        del every
        place = np.arange(len(self.docs)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.first_doc, self.first_word = self.docs[first], place[first].astype(np.uint32)


def content(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def covered(flags: np.ndarray, size: int, k: int) -> np.ndarray:
    """Which of ``size`` words lie in a flagged window of k."""
    steps = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(flags)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def _ask(ranges: int, k: int, salt: int):
    def run(batches):
        def rows():
            for chunk, n, ids, texts in rows_of(batches):
                edges = Edges(*documents_of(n, ids, texts), k, salt)
                sources, number = np.unique(edges.first_doc, return_inverse=True)
                number, head = number.astype(np.uint32), squeeze(sources.tobytes())
                yield from requests_of(chunk, edges.distinct, ranges, lambda a, b: join_blobs([head, pack(number[a:b]), pack(edges.first_word[a:b])]))

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _answer(batches):
    """Per chunk: a bit for each edge that comes in a smaller document elsewhere, and the first places of those."""

    def rows():
        for held in by_range(batches):
            where, hashes, docs, words = [], [], [], []
            for part, chunk, n, data, more in held:
                sources, number, word = split_blobs(more)
                where.append((part, chunk, n))
                hashes.append(unpack_rising(data, np.uint64))
                docs.append(np.frombuffer(unsqueeze(sources), dtype=np.int64)[unpack(number, np.uint32)])
                words.append(unpack(word, np.uint32))
            held.clear()
            edge, doc, word = np.concatenate(hashes), np.concatenate(docs), np.concatenate(words)
            del hashes, docs, words
            order = np.argsort(edge, kind="stable")
            edge, own = edge[order], doc[order]
            starts = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]]))
            sizes = np.diff(np.append(starts, len(edge)))
            least = np.repeat(np.minimum.reduceat(own, starts), sizes)
            at = np.flatnonzero(own == least)
            at = at[np.searchsorted(at, starts)]  # the first that has the smallest document
            smaller = np.empty(len(edge), dtype=bool)
            smaller[order] = least < own
            first_doc, first_word = np.empty_like(doc), np.empty_like(word)
            first_doc[order], first_word[order] = least, np.repeat(word[order][at], sizes)
            end = 0
            for part, chunk, n in where:
                begin, end = end, end + n
                mark = smaller[begin:end]
                sources, number = np.unique(first_doc[begin:end][mark], return_inverse=True)
                places = join_blobs([squeeze(sources.tobytes()), pack(number.astype(np.uint32)), pack(first_word[begin:end][mark])])
                yield part, chunk, n, squeeze(np.packbits(mark).tobytes()), places

    yield from batches_of(rows(), REQUEST_SCHEMA)
    tidy()


def _pack_edges(k: int, salt: int):
    """Repeated edges that follow each other here and, in one block of words, at their first places become one piece."""

    def run(batches):
        def rows():
            for chunk, n, ids, texts, found in rows_of(batches):
                ids, texts = documents_of(n, ids, texts)
                edges = Edges(ids, texts, k, salt)
                doc, word, end = edges.first_doc.copy(), edges.first_word.astype(np.int64), 0
                for a in found or []:
                    at = end + np.flatnonzero(np.unpackbits(np.frombuffer(unsqueeze(a["data"]), np.uint8), count=a["n"]))
                    sources, number, places = split_blobs(a["more"])
                    doc[at], word[at] = np.frombuffer(unsqueeze(sources), dtype=np.int64)[unpack(number, np.uint32)], unpack(places, np.uint32)
                    end += a["n"]
                source, place, end = doc[edges.inverse], word[edges.inverse], 0
                del doc, word, edges.distinct, edges.inverse, edges.first_doc, edges.first_word
                repeats = source < edges.docs
                for d, m in zip(edges.order.tolist(), edges.counts.tolist()):
                    begin, end = end, end + m
                    at = np.flatnonzero(repeats[begin:end])
                    if not len(at):
                        continue
                    s, p, w = source[begin:end][at], place[begin:end][at], texts[d].split()
                    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(s) != 0) | (np.diff(p) != 1) | (p[1:] % BLOCK == 0)) + 1
                    starts = np.concatenate([[0], cut])
                    for a, b in zip(starts.tolist(), np.append(cut, len(at)).tolist()):
                        first, size = int(at[a]), b - a + k - 1
                        yield chunk, d, first, size, int(s[a]), int(p[a]), content(w[first : first + size])

        yield from batches_of(rows(), PATH_SCHEMA, 1 << 20)
        tidy()

    return run


def _cut(k: int):
    """Pieces, cut to their edges."""

    def run(batches):
        def rows():
            for chunk, n, ids, texts, found in rows_of(batches):
                texts, held = documents_of(n, ids, texts)[1], {}
                for s in found:
                    held.setdefault(s["row"], []).append(s)
                for d, own in held.items():
                    w = texts[d].split()
                    for s in own:
                        for e in range(s["n_words"] - k + 1):
                            at = s["first_word"] + e
                            yield chunk, d, at, k, s["source"], s["source_word"] + e, content(w[at : at + k])

        yield from batches_of(rows(), PATH_SCHEMA, 1 << 20)
        tidy()

    return run


OWNER_SCHEMA = pa.schema([("source", pa.int64()), ("chunk", pa.int64())])


def _owners(batches):
    for chunk, n, ids in rows_of(batches):
        known = sorted({i for i in unpack_ids(ids, n) if i is not None})
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array([chunk] * len(known), pa.int64())], schema=OWNER_SCHEMA)


CLAIM = "source long, source_word int, n_words int, content binary"
CLAIM_SCHEMA = pa.schema([("source", pa.int64()), ("source_word", pa.int32()), ("n_words", pa.int32()), ("content", pa.binary())])


def _verify(batches):
    """The claims whose words are at their source's coordinates."""

    def rows():
        for n, ids, texts, claims in rows_of(batches):
            ids, texts = documents_of(n, ids, texts)
            asked: dict[int, list] = {}
            for c in claims:
                asked.setdefault(c["source"], []).append(c)
            for i, text in zip(ids, texts):
                if i in asked:
                    w = text.split()
                    for c in asked[i]:
                        part = w[c["source_word"] : c["source_word"] + c["n_words"]]
                        if content(part) == c["content"]:
                            yield c["source"], c["source_word"], c["n_words"], c["content"]

    yield from batches_of(rows(), CLAIM_SCHEMA, 1 << 20)
    tidy()


def _remove(batches):
    def rows():
        for n, ids, texts, found in rows_of(batches):
            ids, texts = documents_of(n, ids, texts)
            spans: dict[int, list] = {}
            for s in found or []:
                spans.setdefault(s["row"], []).append({c: s[c] for c in ("first_word", "n_words", "source", "source_word")})
            for d, (i, text) in enumerate(zip(ids, texts)):
                w, own = text.split(), spans.get(d, [])
                if own:
                    steps = np.zeros(len(w) + 1, dtype=np.int64)
                    np.add.at(steps, [s["first_word"] for s in own], 1)
                    np.add.at(steps, [s["first_word"] + s["n_words"] for s in own], -1)
                    gone = (np.cumsum(steps[:-1]) > 0).tolist()
                    yield i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode(), own
                else:
                    yield i, len(w), 0, b" ".join(w).decode(), []

    yield from batches_of(rows(), RESULT_SCHEMA, 512 << 10)
    tidy()


PLACE = ["chunk", "row", "first_word", "n_words", "source", "source_word"]


def checked(claims: DataFrame, total: int, rows: DataFrame) -> DataFrame:
    """The claims, ``total`` in number, whose words are at their source.

    Sources and chunks that hold very many claims are joined by broadcast. A chunk with over CLAIMS of them is
    checked in turns, dealt by the claims' hashes: its texts are copied once for each, and each is a row of its own.
    """
    columns = ["source", "source_word", "n_words", "content"]
    sizes = claims.groupBy("source").agg(F.count(F.lit(1)).alias("_size"))
    owners = rows.select("chunk", "n", "ids").mapInArrow(_owners, "source long, chunk long")
    owners = written(owners.join(sizes, "source"), "debruijn-owners")
    placed = written(lookup(claims.select(*columns), owners, "source", total, how="inner", size="_size"), "debruijn-placed")
    asked = placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("_size"))
    asked = written(asked.withColumn("turns", F.ceil(F.col("_size") / CLAIMS).cast("int")), "debruijn-turns")
    turn = F.pmod(F.xxhash64(*columns), F.col("turns")).cast("int")
    lists = lookup(placed, asked, "chunk", placed.count(), how="inner", size="_size").withColumn("turn", turn)
    lists = written(lists.groupBy("chunk", "turns", "turn").agg(F.collect_list(F.struct(*columns)).alias("claims")), "debruijn-asked")
    one = rows.join(lists.where("turns = 1"), "chunk")
    more = asked.where("turns > 1").select("chunk", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    more = rows.join(more, "chunk").join(lists.where("turns > 1"), ["chunk", "turn"])
    needed = ["n", "ids", "texts", "claims"]
    return one.select(*needed).unionByName(more.select(*needed)).mapInArrow(_verify, CLAIM).distinct()


def verified(every: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The pieces whose words are at their source, and the others, if there are any."""
    columns = ["source", "source_word", "n_words", "content"]
    claim = F.concat_ws(":", F.hex("content"), "source", "source_word", "n_words").alias("claim")
    claims = written(every.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "debruijn-claims")
    total, named, n = claims.count(), every.withColumn("claim", claim), every.count()
    good = written(checked(claims, total, rows).join(claims, columns).select(claim, "_n"), "debruijn-verified")
    found = lookup(named, good, "claim", n, how="inner").select(*PLACE)
    if good.count() == total:
        return found, None
    bad = claims.select(claim, "_n").join(good.select("claim"), "claim", "left_anti")
    return found, lookup(named, written(bad, "debruijn-unverified"), "claim", n, how="inner").select(*PLACE)


def pieces(rows: DataFrame, k: int, parts: int, ranges: int, salt: int) -> tuple[DataFrame, bool]:
    """The verified pieces of a chunk table, with their own coordinates and the source's, and whether all are verified."""
    found = answers(rows.select("chunk", "n", "ids", "texts").mapInArrow(_ask(ranges, k, salt), REQUEST), _answer, parts, ranges)
    every = written(rows.join(found, "chunk", "left").select("chunk", "n", "ids", "texts", "answers").mapInArrow(_pack_edges(k, salt), PATH), "debruijn-pieces")
    good, rest = verified(every, rows)
    if rest is None:
        return good, True
    rest = rest.groupBy("chunk").agg(F.collect_list(F.struct("row", "first_word", "n_words", "source", "source_word")).alias("cut"))
    single = written(rows.join(rest, "chunk").select("chunk", "n", "ids", "texts", "cut").mapInArrow(_cut(k), PATH), "debruijn-edges")
    more, rest = verified(single, rows)
    return good.unionByName(more), rest is None


def compacted(found: DataFrame, k: int) -> DataFrame:
    """Pieces of which one ends where the next begins, here and at the source, joined to nonbranching paths."""
    edges = F.col("n_words") - (k - 1)
    ends = found.select("chunk", "row", "source", (F.col("first_word") + edges).alias("first_word"), (F.col("source_word") + edges).alias("source_word"), F.lit(0).alias("fresh"))
    met = found.join(ends, ["chunk", "row", "source", "first_word", "source_word"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(1)))
    path = F.sum("fresh").over(Window.partitionBy("chunk", "row").orderBy("first_word"))
    head = F.min(F.struct("first_word", "source", "source_word")).alias("head")
    joined = met.withColumn("path", path).groupBy("chunk", "row", "path").agg(head, (F.sum(edges) + (k - 1)).cast("int").alias("n_words"))
    return joined.select("chunk", "row", "head.first_word", "n_words", "head.source", "head.source_word")


def paths(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """The verified paths of a chunk table; edges that share a hash are told apart under further hashes."""
    ranges, out, salt, done = ranges_of(rows.agg(F.sum("size")).first()[0] or 0, parts), None, 0, False
    while not done:
        found, done = pieces(rows, k, parts, ranges, salt)
        own = compacted(found, k)
        out, salt = own if out is None else out.unionByName(own), salt + 1
    return out


def without_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by spaces) and the removed paths of each document."""
    parts = partitions(docs.sparkSession)
    rows = chunk_table(docs.select(F.col(id_col).cast("long"), text_col), "word_chunks", parts, CHUNK_BYTES)
    own = paths(rows, k, parts).groupBy("chunk").agg(F.collect_list(F.struct("row", "first_word", "n_words", "source", "source_word")).alias("spans"))
    return rows.join(own, "chunk", "left").select("n", "ids", "texts", "spans").mapInArrow(_remove, RESULT)


def op10_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans of K words or more in every whole text of ``documents``."""
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE gone),
r AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_filter(w, lambda x, j: NOT list_contains(js, j)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""
