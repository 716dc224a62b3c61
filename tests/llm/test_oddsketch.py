"""MinHash near-duplicates against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import oddsketch
from tests.llm.test_simhash import roots


def plain(text):
    words = (text or "").encode().lower().split()
    if len(words) < 3:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(words, words[1:], words[2:]))


def brute(rows):
    """{row number: (size, component)} of (id, text) rows, every pair compared."""
    sets = [plain(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root, least = roots(pairs), {}
    for i, (key, _) in enumerate(rows):
        r = root.get(i, i)
        least[r] = min([x for x in (least.get(r), key) if x is not None], default=None)
    return sorted(((str(k), len(sets[i]), str(k if not sets[i] else least[root.get(i, i)])) for i, (k, _) in enumerate(rows)))


def found(frame):
    out = oddsketch.near_duplicates(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out)


def family(rng, words, copies, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"w{rng.randrange(5000)}"
        out.append(" ".join(own))
    return out


def test_equals_brute_force_on_the_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


@pytest.fixture(scope="module")
def planted():
    """Families whose similarities lie on both sides of the threshold, chains among them, and boilerplate."""
    rng = random.Random(7)
    texts = [t for words, copies, edits in ((40, 30, 3), (120, 60, 6), (300, 40, 16), (6, 12, 1), (25, 25, 2)) for t in family(rng, words, copies, edits)]
    boiler = " ".join(f"b{i}" for i in range(200))
    texts += [boiler + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), texts[50] + "  ", "one two", "ONE  two", "one"]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "leaders", "block"), [(512, 2048, 512), (8, 2048, 512), (8, 3, 6)])
def test_groups_of_any_size_lose_no_link(spark, planted, monkeypatch, small, leaders, block):
    """Smaller bounds make buckets stream, deal them out again, and split families into blocks."""
    monkeypatch.setattr(oddsketch, "BLOCK_SETS", block)
    inner = oddsketch._compared

    def bounded(last, rule):
        run = inner(last, rule)

        def work(batches):  # the workers have a module of their own
            oddsketch.SMALL, oddsketch.LEADERS = small, leaders
            yield from run(batches)

        return work

    monkeypatch.setattr(oddsketch, "_compared", bounded)
    frame = spark.createDataFrame(planted, "doc_id long, text string").repartition(5)
    assert found(frame) == brute(planted)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs) == brute(rows)
    assert found(no_docs) == []


def test_repeated_and_null_ids(spark):
    a = " ".join(f"a{i}" for i in range(50))
    rows = [(1, a), (1, a + " b"), (1, "x y z"), (None, a), (None, a + " c"), (None, "p q r s"), (None, "p q r s"), (5, "x y z"), (1, a)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for j in (0.85, 0.9, 0.97):
        n = 4000
        d = int(n * (1 - j) / (1 + j))
        a = np.unique(rng.integers(0, 1 << 63, n + d, dtype=np.uint64))
        errors = [oddsketch.similarity(*(oddsketch.odd_sketch(oddsketch.samples(s)) for s in (a[:n], np.concatenate([a[d:n], a[n:]])))) - j]
        assert abs(np.mean(errors)) < 0.08
    assert oddsketch.similarity(oddsketch.odd_sketch(oddsketch.samples(a[:n])), oddsketch.odd_sketch(oddsketch.samples(a[:n]))) == 1


def test_links_are_counted_exactly():
    sets = [np.arange(0, 185, dtype=np.uint64), np.arange(15, 200, dtype=np.uint64), np.arange(14, 200, dtype=np.uint64), np.arange(500, 510, dtype=np.uint64)]
    # 170 of 200 is a link, 171 of 200 too; the last is alone
    assert oddsketch.linked(sets).tolist() == [0, 0, 0, 3]
    assert oddsketch.linked([np.arange(0, 185, dtype=np.uint64), np.arange(16, 201, dtype=np.uint64)]).tolist() == [0, 1]


def test_rows_that_share_a_key_are_found_over_batches():
    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.binary())], names=["key", "node"])

    given = [batch((1, b"a"), (2, b"b")), batch((2, b"c")), batch(), batch((2, b"d"), (3, b"e")), batch((4, b"f")), batch((4, b"g"))]
    got = [(r["key"], r["node"]) for b in oddsketch._shared(given) for r in b.to_pylist()]
    assert got == [(2, b"b"), (2, b"c"), (2, b"d"), (4, b"f"), (4, b"g")]


def test_sketches_are_connected_as_by_all_pairs():
    rng = np.random.default_rng(4)
    odd = rng.integers(0, 1 << 63, (40, 16), dtype=np.uint64)
    chain = np.concatenate([odd, odd ^ np.uint64(1), odd[:9] ^ np.uint64(7), odd[3:4]])[rng.permutation(90)]
    assert (oddsketch._spread(chain, 32) == oddsketch._like(chain, 32)).all() and len(set(oddsketch._spread(chain, 32))) == 40
    assert len(oddsketch._spread(odd[:0], 3)) == 0 and oddsketch._spread(odd[:1], 3).tolist() == [0]
