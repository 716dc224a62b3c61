"""MinHash near-duplicates with odd sketches: links of 85 % and more between sets of three-word shingles.

A set has SAMPLES MinHash samples. Its *odd sketch* folds them into a bitmap, each sample flipping one bit,
so that the XOR of two sketches has about one bit for each sample in which the sets differ: few bits say
precisely how similar two very similar sets are. BANDS bands of BAND samples each deal the sets into buckets;
two sets at the threshold miss all buckets with probability (1 - 0.85**4)**24 = 2e-8. In a bucket sketches
within DISTANCE of each other are candidates; a link at the threshold has a mean distance of 71 with a
deviation of 11, so DISTANCE lies six deviations above it.

What connects candidates makes *families*. The full sets of a family are gathered in blocks of bounded bytes,
and all intersections within a block are counted at once. Of a family of several blocks, all sets that aren't
in its largest class then meet every block once more; sets of the largest class need not meet each other
across blocks, they are connected already. So links are exact, and no pairs are written: a bucket or block
sends on only what connects it.

A :class:`Rule` says what the shingles, the threshold and the sketches are; ODD is this operator's. Other
operators give rules with sketches of their own.

A bucket of over SMALL members is read as a stream. Members within NEAR of one of its leaders join it, others
become leaders; distances obey the triangle inequality, so leaders of linked members are within 2 * NEAR +
DISTANCE of each other. A bucket of more than LEADERS leaders holds mostly unlike sets: it is dealt out again
by the other bands, and what then still has so many leaders is one family, which the confirmation takes apart.

Sets are named by 128 bits of sums over their shingles' 64-bit names; equal sets are one node.

Defined cases: null, empty and blank texts have the empty set, size zero, and link with nothing; fewer than three
words are one shingle; null ids are no component's id unless all of its ids are null; repeated ids and rows keep
their rows; an empty table gives no rows; texts are used whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, partitions, table, written
from tidemark.llm.components import components

SHINGLE, SEED = 3, 42
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
SAMPLES, BANDS, BAND, BITS = 256, 24, 4, 1024
DISTANCE, NEAR = 140, 40
#: Members of a bucket that are compared pair by pair, and leaders of a larger one.
SMALL, LEADERS = 512, 16_384
#: Pairs within small buckets that are looked at in one go.
PAIRS = 1 << 19
#: Sets and bytes of a block, on average.
BLOCK_SETS, BLOCK_BYTES = 512, 4 << 20
#: Shingles whose occurrences in a block are counted at a time.
SLAB = 8192
#: Up to this many candidates (about 70 bytes each) are broadcast to find their texts.
BROADCAST_NODES = 200_000
RNG = np.random.default_rng(13)
FACTORS = RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
SALTS = RNG.integers(0, 1 << 63, (BANDS, BAND), dtype=np.uint64) | np.uint64(1)
PIECE = 1 << 11


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles of ``size`` words of a text with A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + len(words))] if words else [], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    name = mixed(h[:n])
    for k in range(1, size):
        name = mixed(name + h[k : n + k] * np.uint64(2 * k + 1))
    return np.unique(name)


def node_of(names: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mixed(names + np.uint64(1)).sum(dtype=np.uint64), mixed(names ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def samples(names: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of SAMPLES permutations."""
    h = (names >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), PIECE):
        np.minimum(least, (FACTORS[:, None] * h[None, at : at + PIECE]).min(axis=1), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    part = least[: BANDS * BAND].astype(np.uint64).reshape(BANDS, BAND)
    return mixed((mixed(part + SALTS) * SALTS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """BITS bits, of which each sample flips one."""
    at = mixed(least.astype(np.uint64) << np.uint64(16) | np.arange(SAMPLES, dtype=np.uint64)) >> np.uint64(54)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """What two odd sketches say about the similarity of their sets."""
    apart = min(0.499, int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum()) / BITS)
    return 1 + BITS / 2 * np.log(1 - 2 * apart) / (2 * SAMPLES)


def odd_of(names: np.ndarray, least: np.ndarray) -> bytes:
    return odd_sketch(least)


SKETCHED = "n_shingles long, node binary, bands array<long>, odd binary, hash long"


@dataclass(frozen=True)
class Rule:
    """What links, and how it is found.

    Links are between sets of shingles of ``words`` words with 100 * intersection >= ``percent`` * union. ``sketch``
    makes a bitmap of ``bits`` bits of a set and its samples; those of links are within ``distance`` of each other,
    those within ``near`` may stand for each other. ``connect`` labels the members of several small buckets, given
    as sketches, sizes and the buckets' starts.
    """

    words: int
    percent: int
    sketch: Callable[[np.ndarray, np.ndarray], bytes]
    bits: int
    distance: int
    near: int
    connect: Callable[[np.ndarray, np.ndarray, np.ndarray, Rule], np.ndarray]


def sketches(docs: DataFrame, key: str = "doc_id", rule: Rule | None = None) -> DataFrame:
    """``key``, n_shingles, node, bands, odd and the text's hash of each document; an empty set has no node."""
    rule = rule or ODD

    def run(batches):
        for b in batches:
            sizes, nodes, bands, odd = [], [], [], []
            for t in b.column(1):
                names = shingles(t.as_py(), rule.words)
                least = samples(names)
                sizes.append(len(names))
                nodes.append(node_of(names) if len(names) else None)
                bands.append(bands_of(least))
                odd.append(rule.sketch(names, least))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * BANDS
            flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(ends, flat), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, b.column(2)], [key, "n_shingles", "node", "bands", "odd", "hash"])

    return docs.select(key, "text", F.xxhash64("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {SKETCHED}")


def _groups(batches, width: int):
    """Slices of sorted rows that agree in the first ``width`` columns: (key, slice, whether the key is new)."""
    at = None
    for b in batches:
        keys = list(zip(*[b.column(i).to_pylist() for i in range(width)]))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], b.slice(start, i - start), keys[start] != at
                at, start = keys[start], i


def _shared(batches):
    """The rows (key, node), sorted by key, whose key has another row."""
    held = None  # the last row and whether it has been sent
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        same = key[1:] == key[:-1]
        both = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if held is not None and held[0].column(0)[0].as_py() == key[0]:
            both[0] = True
            if not held[1]:
                yield held[0]
        yield b.filter(pa.array(both))
        held = b.slice(b.num_rows - 1, 1), bool(both[-1])


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of the sketches ``a`` (rows of 64-bit words) and each of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _like(odd: np.ndarray, most: int, sizes: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """Labels of sketches connected by distances of at most ``most``; ``sizes`` leaves out pairs whose sizes allow no link."""
    pairs = []
    for at in range(0, len(odd), SMALL):
        near = _distances(odd[at : at + SMALL], odd) <= most
        if sizes is not None:
            s, z = sizes[at : at + SMALL, None], sizes[None, :]
            near &= 100 * np.minimum(s, z) >= percent * np.maximum(s, z)
        a, b = np.nonzero(near)
        pairs.append(np.stack([a + at, b])[:, a + at < b])
    a, b = np.concatenate(pairs, axis=1)
    return _labels(len(odd), a, b)


def _spread(odd: np.ndarray, most: int) -> np.ndarray:
    """Labels as :func:`_like` gives them, for many sketches: each is compared once with those that aren't reached yet."""
    label, pool = np.arange(len(odd)), np.arange(1, len(odd))
    for first in range(len(odd)):
        if label[first] != first:
            continue
        pool = pool[pool != first]
        queue = [first]
        while queue and len(pool):
            near = _distances(odd[pool], odd[queue.pop()][None, :])[:, 0] <= most
            found, pool = pool[near], pool[~near]
            label[found] = first
            queue += found.tolist()
    return label


def each_bucket(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray, rule: Rule) -> np.ndarray:
    """Labels of the members of small buckets, all sketches of a bucket compared."""
    out = [a + _like(words[a:b], rule.distance, sizes[a:b], rule.percent) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)])]
    return np.concatenate(out)


ODD = Rule(SHINGLE, PERCENT, odd_of, BITS, DISTANCE, NEAR, each_bucket)


EDGES = "deeper long, a binary, b binary"
EDGE_SCHEMA = pa.schema([("deeper", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _edges(nodes: list[bytes], label: np.ndarray) -> pa.RecordBatch:
    off = np.flatnonzero(label != np.arange(len(label))).tolist()
    columns = [pa.nulls(len(off), pa.int64()), pa.array([nodes[i] for i in off], pa.binary()), pa.array([nodes[label[i]] for i in off], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=EDGE_SCHEMA)


class _Bucket:
    """The members of one bucket, which come in slices."""

    def __init__(self, key: int, last: bool, rule: Rule):
        self.key, self.last, self.rule, self.streamed = key, last, rule, False
        self.nodes: list[bytes] = []  # members of a small bucket, or leaders
        self.odd, self.sizes = np.zeros((0, rule.bits // 64), dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.first, self.over = None, False

    def add(self, rows: pa.RecordBatch):
        nodes, odd = rows.column(1).to_pylist(), np.frombuffer(b"".join(rows.column(3).to_pylist()), dtype=np.uint64).reshape(-1, self.rule.bits // 64)
        if self.over and not self.last:
            return
        self.first = self.first or nodes[0]
        if self.over:  # all are one family
            yield _star(nodes, self.first)
        elif not self.streamed and len(self.nodes) + len(nodes) <= SMALL:
            self.nodes += nodes
            self.odd, self.sizes = np.concatenate([self.odd, odd]), np.concatenate([self.sizes, rows.column(2).to_numpy()])
        else:
            if not self.streamed:
                nodes, odd, self.streamed = self.nodes + nodes, np.concatenate([self.odd, odd]), True
                self.nodes, self.odd = [], self.odd[:0]
            for at in range(0, len(nodes), SMALL):
                yield from self._led(nodes[at : at + SMALL], odd[at : at + SMALL])

    def _led(self, nodes: list[bytes], odd: np.ndarray):
        if self.over:
            if self.last:
                yield _star(nodes, self.first)
            return
        a, b = [], []
        rest = np.arange(len(nodes))
        if len(self.nodes):
            far = _distances(odd, self.odd)
            best = far.argmin(axis=1)
            near = far[rest, best] <= self.rule.near
            a, b = [nodes[i] for i in rest[near].tolist()], [self.nodes[i] for i in best[near].tolist()]
            rest = rest[~near]
        while len(rest):
            lead, rest = rest[0], rest[1:]
            self.nodes.append(nodes[lead])
            self.odd = np.concatenate([self.odd, odd[lead : lead + 1]])
            near = _distances(odd[rest], odd[lead : lead + 1])[:, 0] <= self.rule.near
            a += [nodes[i] for i in rest[near].tolist()]
            b += [nodes[lead]] * int(near.sum())
            rest = rest[~near]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=EDGE_SCHEMA)
        if len(self.nodes) > LEADERS:
            self.over = True
            if self.last:
                yield _star(self.nodes, self.first)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([self.key]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=EDGE_SCHEMA)

    def close(self):
        """What connects the leaders of a large bucket."""
        if self.streamed and not self.over and len(self.nodes) > 1:
            yield _edges(self.nodes, _spread(self.odd, 2 * self.rule.near + self.rule.distance))


def _star(nodes: list[bytes], first: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(nodes, pa.binary()), pa.array([first] * len(nodes), pa.binary())], schema=EDGE_SCHEMA)


class _Small:
    """Small buckets, which are compared some at a time."""

    def __init__(self, rule: Rule):
        self.rule, self.held, self.pairs = rule, [], 0

    def add(self, bucket: _Bucket):
        if len(bucket.nodes) > 1:
            self.held.append(bucket)
            self.pairs += len(bucket.nodes) ** 2
        if self.pairs > PAIRS:
            yield from self.flush()

    def flush(self):
        if self.held:
            starts = np.cumsum([0, *(len(b.nodes) for b in self.held[:-1])])
            words, sizes = np.concatenate([b.odd for b in self.held]), np.concatenate([b.sizes for b in self.held])
            yield _edges([n for b in self.held for n in b.nodes], self.rule.connect(words, sizes, starts, self.rule))
        self.held, self.pairs = [], 0


def _compared(last: bool, rule: Rule):
    """Rows (key, node, n_shingles, odd), sorted by key, to what connects candidates, or to keys that must be dealt out again."""

    def run(batches):
        bucket, small = None, _Small(rule)

        def ended():
            if bucket is not None:
                yield from bucket.close() if bucket.streamed or bucket.over else small.add(bucket)

        for (key,), rows, new in _groups(batches, 1):
            if new:
                yield from ended()
                bucket = _Bucket(key, last, rule)
            yield from bucket.add(rows)
        yield from ended()
        yield from small.flush()

    return run


def candidates(nodes: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Edges (a, b) that connect all nodes (node, n_shingles, bands, odd) whose sketches are near in some bucket."""
    parts, rule = partitions(nodes.sparkSession), rule or ODD
    bands = nodes.select("node", F.explode("bands").alias("key"))
    edges = None
    for last in (False, True):
        sorted_ = bands.repartition(parts, "key").select("key", "node").sortWithinPartitions("key")
        shared = written(sorted_.mapInArrow(_shared, "key long, node binary"), "oddsketch-shared")
        members = shared.join(nodes.select("node", "n_shingles", "odd"), "node").select("key", "node", "n_shingles", "odd")
        found = written(members.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_compared(last, rule), EDGES), "oddsketch-candidates")
        here = found.where("deeper IS NULL").select("a", "b")
        edges = here if edges is None else edges.unionByName(here)
        again = found.where("deeper IS NOT NULL").select(F.col("deeper").alias("key"))
        if last or again.isEmpty():
            return edges
        crowded = shared.join(again, "key", "left_semi").join(nodes.select("node", "bands"), "node")
        crowded = crowded.select("node", "key", F.explode("bands").alias("band")).where("key != band")
        bands = crowded.select("node", F.xxhash64(F.least("key", "band"), F.greatest("key", "band")).alias("key")).distinct()
    return edges


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Labels of sets that are connected by links; intersections of all pairs are counted at once."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    wide = often > 1  # a shingle of one set is in no intersection
    column = np.cumsum(wide) - 1
    keep = wide[at]
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((n, n), dtype=np.int64)
    for start in range(0, int(wide.sum()), SLAB):
        i, j = np.searchsorted(at, [start, start + SLAB])
        has = np.zeros((n, min(SLAB, int(wide.sum()) - start)), dtype=np.float32)
        has[owner[i:j], at[i:j] - start] = 1
        common += (has @ has.T).astype(np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    a, b = np.nonzero(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
    return _labels(n, a[a < b], b[a < b])


def _confirmed(percent: int):
    """Rows (root, block, node, names), sorted by block, to what connects each block's sets by links."""

    def run(batches):
        held: dict[bytes, np.ndarray] = {}

        def close():
            if len(held) > 1:
                yield _edges(list(held), linked(list(held.values()), percent))

        for _, rows, new in _groups(batches, 2):
            if new:
                yield from close()
                held = {}
            for node, names in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()):
                held[node] = np.frombuffer(names, dtype=np.uint64)  # repeated rows are one set
        yield from close()

    return run


def _met(sets: DataFrame, percent: int) -> DataFrame:
    """What connects the sets (root, block, node, names) of each block by links."""
    dealt = sets.repartition(partitions(sets.sparkSession), "root", "block").select("root", "block", "node", "names").sortWithinPartitions("root", "block")
    return dealt.mapInArrow(_confirmed(percent), EDGES).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, words: int) -> DataFrame:
    """The columns of ``wanted`` (node, rep and others) with the names of the node's set, from the texts of ``docs``.

    ``rep`` is the id and the text's hash of a row that has the set, so a repeated id finds only its own rows.
    """
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    others = [c for c in wanted.columns if c not in ("rep", "node")]
    wanted = wanted.select("node", *others, F.col("rep.id").alias("_rep"), F.col("rep.hash").alias("_rep_hash"))
    given = docs.select(F.col(key).alias("_id"), "text", F.xxhash64("text").alias("_hash"))
    given = given.join(F.broadcast(wanted) if few else wanted, F.col("_id").eqNullSafe(F.col("_rep")) & (F.col("_hash") == F.col("_rep_hash")))

    def run(batches):
        for b in batches:
            names = [shingles(t, words) for t in b.column(0).to_pylist()]
            own = [bool(len(s)) and node_of(s) == n for s, n in zip(names, b.column(1).to_pylist())]  # an id may have other texts
            data = pa.array([s.tobytes() if o else None for s, o in zip(names, own)], pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], data], ["node", *others, "names"]).filter(pa.array(own))

    fields = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in others)
    return given.select("text", "node", *others).mapInArrow(run, f"node binary, {fields}, names binary")


def links(docs: DataFrame, nodes: DataFrame, key: str = "doc_id", rule: Rule = ODD) -> DataFrame:
    """Edges (a, b) that connect what links of ``nodes`` connect."""
    family = components(candidates(nodes, rule), "oddsketch-family")
    member = family.unionByName(family.select(F.col("root").alias("node"), "root").distinct())
    member = written(member.join(nodes.select("node", "n_shingles", "rep"), "node"), "oddsketch-members")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") * 8 / BLOCK_BYTES)).alias("blocks")
    sizes = member.groupBy("root").agg(blocks, F.count(F.lit(1)).alias("_n"))
    member = lookup(member, sizes, "root", member.count(), how="inner").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    member = written(member.select("root", "node", "rep", "blocks", "block", "n_shingles"), "oddsketch-blocks")
    edges = written(_met(_sets(docs, member.select("rep", "node", "root", "block"), key, rule.words), rule.percent), "oddsketch-links")
    large = member.where("blocks > 1")
    if large.isEmpty():
        return edges
    label = components(edges.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "oddsketch-classes")
    classed = written(large.join(label.select("node", F.col("root").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node")), "oddsketch-classed")
    counts = classed.groupBy("root", "class").agg(F.count(F.lit(1)).alias("n"))
    giant = counts.groupBy("root").agg(F.max(F.struct("n", "class")).alias("most"), F.sum("n").alias("_n")).select("root", F.col("most.class").alias("giant"), "_n")
    known = written(lookup(classed, giant, "root", classed.count(), how="inner"), "oddsketch-giants")
    active = known.where(F.col("class") != F.col("giant"))
    if active.isEmpty():
        return edges
    turns = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_shingles") * 8 / BLOCK_BYTES)).alias("turns")
    turned = active.groupBy("root").agg(turns, F.count(F.lit(1)).alias("_n"))
    everyone = lookup(known, turned, "root", known.count(), how="inner")
    first = everyone.select("node", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "turns")
    second = everyone.where(F.col("class") != F.col("giant")).withColumn("turn", F.pmod(F.xxhash64("node", F.lit(1)), "turns"))
    second = second.select("node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "turn", "turns")
    meetings = first.unionByName(second).select("node", "root", (F.col("block") * F.col("turns") + F.col("turn")).alias("block"))
    sets = written(_sets(docs, large.select("node", "rep", "root"), key, rule.words).select("node", "names").dropDuplicates(["node"]), "oddsketch-sets")
    return edges.unionByName(written(_met(sets.join(meetings, "node"), rule.percent), "oddsketch-further"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", rule: Rule = ODD) -> DataFrame:
    """``key``, n_shingles, component_id (the smallest ``key`` reachable) and kept of every document."""
    rows = written(sketches(docs, key, rule), "oddsketch-documents")
    known = rows.where(F.col("node").isNotNull())
    facts = [F.min(key).alias("least"), F.min(F.struct(F.col(key).alias("id"), "hash")).alias("rep"), F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "odd")]]
    nodes = written(known.groupBy("node").agg(*facts), "oddsketch-nodes")
    root = components(links(docs, nodes, key, rule), "oddsketch-roots")
    rooted = written(nodes.select("node", "least", "_n").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "oddsketch-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    classes = written(lookup(rooted, least, "root", rooted.count(), how="inner", size="_size").select("node", "component_id", "_n"), "oddsketch-components")
    found = lookup(rows.select(key, "n_shingles", "node"), classes, "node", rows.count(), how="left")
    component = F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return found.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


#: The same by a join of all shingles.
ORACLE_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every whole text of ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
