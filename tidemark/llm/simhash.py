"""SimHash near-duplicates: fingerprints of whole texts and a binary-trie self-join.

The trie of all fingerprints is joined with itself by going down pairs of nodes together: the bits in
which the two branches differ are added up, and a pair over the error budget is dropped with all that
is below it. To deal the traversal out, the 64 bits are cut into six blocks. Fingerprints that differ
in three bits or fewer agree on at least three blocks, so each link lies below the diagonal of a trie
whose first bits are some three of the six blocks: one trie for each of the 20 choices, its upper part
walked by the shuffle on those blocks, its lower part by one task for each group of equal blocks. A
group of over GROUP_MOST distinct fingerprints isn't walked but dealt out again: its free bits are cut
in four, of which one must agree, and the rows go to four deeper keys. At eleven free bits a group has
GROUP_MOST values at most, so this ends and no group is unbounded.

Links are between distinct fingerprints (exact copies are one), and a group sends on only what
connects it, so no quadratic set of pairs is written.

:func:`similar_removed` is for links by similarity, which three bits find hardly any of: fingerprints of 256
bits of the sets of five-word shingles, dealt out by MinHash bands, of which similar sets share one; the tries of
many small groups are walked at once within a budget of 80 bits, and what is near is confirmed on the full sets
(:mod:`tidemark.llm.oddsketch`).

Defined cases: null and wordless texts have fingerprint zero, which links like any other; null ids
never become a component's id unless all are null; repeated ids keep their rows; an empty table gives
no rows; texts are used whole; further columns are ignored by :func:`near_duplicates`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import oddsketch
from tidemark.llm.common import lookup, partitions, table, written
from tidemark.llm.components import components

SHINGLE, SEED, BUDGET = 3, 42, 3
GROUP_MOST = 2048
BLOCKS = [0xFFE0000000000000, 0x001FFC0000000000, 0x000003FF80000000, 0x000000007FF00000, 0x00000000000FFC00, 0x00000000000003FF]
MASKS = [a | b | c for a, b, c in combinations(BLOCKS, 3)]
PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included, of a text with A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    total, n = np.zeros(64, dtype=np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + SHINGLE - 1]
        hashes = np.fromiter((digest(b"%b %b %b" % w, SEED) for w in zip(part, part[1:], part[2:])), dtype=">u8", count=len(part) - SHINGLE + 1)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            found = [fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)]
            fp = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*keep, "fp"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col("text")).mapInArrow(run, ", ".join([*fields, "fp long"]))


def trie_pairs(values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the distinct sorted ``values`` that differ in ``budget`` bits or fewer.

    A node of the trie is a range of ``values`` with equal leading bits. All pairs of nodes of a
    depth are expanded at once; bits in which no values differ make no depth of their own.
    """
    first = second = np.zeros(0, dtype=np.int64)
    n = len(values)
    if n < 2:
        return first, second
    varied = int(np.bitwise_or.reduce(values ^ values[0]))
    nodes = np.array([[0], [n], [0], [n], [0]], dtype=np.int64)  # from, to, from, to, differing bits
    out: list[np.ndarray] = []
    for bit in range(63, -1, -1):
        if not varied >> bit & 1:
            continue
        ones = np.concatenate([[0], np.cumsum(values >> np.uint64(bit) & np.uint64(1), dtype=np.int64)])
        a, z, b, y, bits = nodes
        m, k = z - (ones[z] - ones[a]), y - (ones[y] - ones[b])
        own = a == b
        parts = [np.stack([a, m, b, k, bits]), np.stack([m, z, k, y, bits]), np.stack([a, m, k, y, bits + 1]), np.stack([m, z, b, k, bits + 1])[:, ~own]]
        nodes = np.concatenate(parts, axis=1)
        a, z, b, y, bits = nodes
        nodes = nodes[:, (a < z) & (b < y) & (bits <= budget) & ~((a == b) & (z - a == 1))]
        leaves = (nodes[1] - nodes[0] == 1) & (nodes[3] - nodes[2] == 1)
        out.append(nodes[:, leaves][[0, 2]])
        nodes = nodes[:, ~leaves]
    pairs = np.concatenate(out, axis=1)
    near = np.bitwise_count(values[pairs[0]] ^ values[pairs[1]]) <= budget
    return pairs[0][near], pairs[1][near]


def _joined(values: np.ndarray, mask: int) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint linked to it) within one group."""
    a, b = trie_pairs(values)
    if mask in MASKS and len(a):  # a link that several groups see is left to the first of them
        differ, rank = values[a] ^ values[b], np.zeros(len(a), dtype=np.int64)
        first = np.zeros(len(a), dtype=np.uint64)
        for block in BLOCKS:
            same = (differ & np.uint64(block) == 0) & (rank < 3)
            first[same] |= np.uint64(block)
            rank += same
        a, b = a[first == np.uint64(mask)], b[first == np.uint64(mask)]
    label = np.arange(len(values))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return [(int(values[i]), int(values[label[i]])) for i in np.flatnonzero(label != np.arange(len(values)))]


def _split(mask: int) -> list[int]:
    free = [1 << i for i in range(64) if not mask >> i & 1]
    return [mask | sum(free[k * len(free) // 4 : (k + 1) * len(free) // 4]) for k in range(4)]


STEP = "deeper boolean, mask long, fp long, other long"


def _walk(batches):
    """Groups of rows (mask, key, fp) in order: links of a small one, deeper rows of a large one."""

    def signed(x):
        return np.array(x, dtype=np.uint64).view(np.int64)

    def emit(deeper: bool, masks, fps, others):
        return pa.RecordBatch.from_arrays([pa.array([deeper] * len(fps), pa.bool_()), pa.array(signed(masks)), pa.array(signed(fps)), pa.array(signed(others))], STEP.replace(" boolean", "").replace(" long", "").split(", "))

    def close(mask, values):
        links = _joined(np.unique(values), mask) if len(values) > 1 else []
        return links

    def deal(mask, values):
        masks = _split(mask)
        return emit(True, np.repeat(np.array(masks, dtype=np.uint64), len(values)), np.tile(values, 4), np.concatenate([values & np.uint64(m) for m in masks]))

    held, at, large = np.zeros(0, np.uint64), None, False
    for b in batches:
        mask, key, fp = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns)
        if not len(fp):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
        ends, links = np.append(starts[1:], len(fp)), []
        for s, e in zip(starts.tolist(), ends.tolist()):
            here = (int(mask[s]), int(key[s]))
            if here != at:
                if len(held) > 1:
                    links += close(at[0], held)
                held, at, large = fp[s:e], here, False
            else:
                held = np.concatenate([held, fp[s:e]])
            if large or len(held) > GROUP_MOST and 64 - here[0].bit_count() > 11:
                large = True
                yield deal(here[0], held)
                held = np.zeros(0, np.uint64)
        if links:
            yield emit(False, [0] * len(links), [x for x, _ in links], [y for _, y in links])
    if at is not None and len(held) > 1 and (links := close(at[0], held)):
        yield emit(False, [0] * len(links), [x for x, _ in links], [y for _, y in links])


def trie_join(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (fp, no repeats) within BUDGET bits of each other."""
    spark, parts = distinct.sparkSession, partitions(distinct.sparkSession)
    signed = [int(np.uint64(m).view(np.int64)) for m in MASKS]
    rows = distinct.select(F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask"), "fp")
    rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
    edges = spark.createDataFrame([], "a long, b long")
    while True:
        step = written(rows.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_walk, STEP), "simhash-step")
        edges = edges.unionByName(step.where("not deeper").select(F.col("fp").alias("a"), F.col("other").alias("b")))
        deeper = step.where("deeper")
        if deeper.isEmpty():
            return edges
        rows = deeper.select("mask", F.col("other").alias("key"), "fp")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (doc_id first), fp and component_id, the smallest doc_id of the document's component."""
    rows = written(fingerprints(docs, keep), "simhash-documents")
    total = rows.count()
    distinct = written(rows.groupBy("fp").agg(F.min(keep[0]).alias("rep"), F.count(F.lit(1)).alias("_n")), "simhash-distinct")
    linked = components(trie_join(distinct.select("fp")), "simhash")
    rooted = written(
        distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots"
    )
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    classes = lookup(rooted, least, "root", rooted.count(), how="inner", size="_size").select("fp", "component_id", "_n")
    return lookup(rows, written(classes, "simhash-classes"), "fp", total, how="inner")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id, among equals one row.

    The rows are numbered and written once: row numbers follow the splits of a scan, which follow the
    number of cores, so two evaluations may number the same rows differently.
    """
    row = "_row" + "_" * max(len(c) for c in docs.columns)  # no column has this name
    named = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-numbered")
    found = near_duplicates(named.select("doc_id", F.col(row).alias("_row"), "text"), ("doc_id", "_row"))
    stay = found.groupBy(F.coalesce("component_id", F.lit(-1)).alias("c"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("first")
    )
    return named.join(written(stay.select(F.col("first._row").alias(row)), "simhash-kept"), row, "left_semi").drop(row)


#: Words of a shingle, per cent of similarity, and bits of a fingerprint for links by similarity.
SIMILAR_WORDS, SIMILAR_PERCENT, WIDE = 5, 80, 256
#: Fingerprints of sets of similarity 0.8 differ in 39 bits on average (48 for sets of five), with a deviation of 6; unlike ones in 128.
WIDE_BUDGET, WIDE_NEAR = 80, 4
#: Up to this many numbers of rows that go (some 20 bytes each) are broadcast against the texts.
BROADCAST_ROWS = 1_000_000


def wide_fingerprint(names: np.ndarray, least: np.ndarray) -> bytes:
    """SimHash of WIDE bits of a set of 64-bit shingle names, whose hashes are spread to WIDE bits."""
    total = np.zeros(WIDE, dtype=np.int64)
    for at in range(0, len(names), PIECE >> 4):
        part = names[at : at + (PIECE >> 4)]
        spread = np.stack([oddsketch.mixed(part + np.uint64((2 * k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for k in range(WIDE // 64)], axis=1)
        total += np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(names)).tobytes()


def wide_pairs(words: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``words`` within ``budget`` bits of each other, of each group that begins at ``starts``.

    One walk goes down the tries of all groups: it begins with each group's root paired with itself.
    """
    n = len(words)
    ends = np.append(starts[1:], n)
    order = np.lexsort((*words.T[::-1], np.repeat(np.arange(len(starts)), ends - starts)))
    rows = words[order]
    done: list[np.ndarray] = []
    nodes = np.stack([starts, ends, starts, ends, np.zeros_like(starts)])[:, ends - starts > 1]
    for w in range(words.shape[1]):
        for bit in range(63, -1, -1):
            if not nodes.shape[1]:
                break
            ones = np.concatenate([[0], np.cumsum(rows[:, w] >> np.uint64(bit) & np.uint64(1), dtype=np.int64)])
            a, z, b, y, bits = nodes
            m, k = z - (ones[z] - ones[a]), y - (ones[y] - ones[b])
            own = a == b
            parts = [np.stack([a, m, b, k, bits]), np.stack([m, z, k, y, bits]), np.stack([a, m, k, y, bits + 1]), np.stack([m, z, b, k, bits + 1])[:, ~own]]
            nodes = np.concatenate(parts, axis=1)
            a, z, b, y, bits = nodes
            nodes = nodes[:, (a < z) & (b < y) & (bits <= budget) & ~((a == b) & (z - a == 1))]
            single = (nodes[1] - nodes[0] == 1) & (nodes[3] - nodes[2] == 1)
            done.append(nodes[:, single][[0, 2]])
            nodes = nodes[:, ~single]
    # equal rows are still together at the last bit
    for a, z, b, y, _ in nodes.T.tolist():
        i, j = np.meshgrid(np.arange(a, z), np.arange(b, y), indexing="ij")
        done.append(np.stack([i[i < j], j[i < j]]) if a == b else np.stack([i.ravel(), j.ravel()]))
    first, second = np.concatenate(done, axis=1) if done else np.zeros((2, 0), dtype=np.int64)
    near = np.bitwise_count(rows[first] ^ rows[second]).sum(axis=1, dtype=np.int64) <= budget
    return order[first[near]], order[second[near]]


def walked(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rule: oddsketch.Rule) -> np.ndarray:
    """Labels of the members of small groups that near fingerprints connect, where their sizes allow a link."""
    a, b = wide_pairs(words, starts, rule.distance)
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= rule.percent * np.maximum(sizes[a], sizes[b])
    return oddsketch._labels(len(words), np.minimum(a, b)[fits], np.maximum(a, b)[fits])


SIMILAR = oddsketch.Rule(SIMILAR_WORDS, SIMILAR_PERCENT, wide_fingerprint, WIDE, WIDE_BUDGET, WIDE_NEAR, walked)


def similar_removed(docs: DataFrame) -> DataFrame:
    """One document of each component of similar texts (five words, 0.8): the one with the smallest id, among equals one row.

    Texts without words are similar to nothing and stay. The rows are numbered and written once.
    """
    row = "_row" + "_" * max(len(c) for c in docs.columns)  # no column has this name
    named = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-numbered")
    rows = named.select(F.col(row).alias("_row"), "text")
    found = written(oddsketch.near_duplicates(rows, "_row", SIMILAR).select("_row", "component_id"), "simhash-similar")
    known = found.join(named.select(F.col(row).alias("_row"), "doc_id"), "_row")
    stay = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("first"))
    gone = found.select("_row").join(stay.select("first._row"), "_row", "left_anti").select(F.col("_row").alias(row))
    gone = written(gone, "simhash-gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else the texts are shuffled once
    return named.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of ``documents``."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
