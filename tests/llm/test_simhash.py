import numpy as np
import pytest

from tidemark.llm import simhash
from tidemark.llm.components import components


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_trie_pairs_are_all_pairs_within_the_budget():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    near = np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (6, 2))])
    values = np.unique(near)
    a, b = simhash.trie_pairs(values)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want)


@pytest.mark.parametrize("most", [2048, 8])
def test_groups_that_are_dealt_again_lose_no_link(spark, monkeypatch, most):
    """One group holds hundreds of fingerprints; the smaller bound makes it go through the deeper keys."""
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 14, 300).astype(np.uint64), rng.integers(0, 2**63, 200, dtype=np.int64).view(np.uint64)]))
    monkeypatch.setattr(simhash, "GROUP_MOST", most)
    step = simhash._walk

    def walk(batches, limit=most):
        simhash.GROUP_MOST = limit
        yield from step(batches)

    monkeypatch.setattr(simhash, "_walk", walk)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.trie_join(frame)
    linked = {r.node: r.root for r in components(edges, "test").collect()}
    signed = values.view(np.int64).tolist()
    pairs = [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3]
    want = {x: r for x, r in roots(pairs).items() if x != r}
    assert linked == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (500, 499), (499, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: r for x, r in roots(edges).items() if x != r}


def test_documents_match_brute_force(spark, sf_small, texts):
    rows = simhash.op4_simhash(spark, sf_small).collect()
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    ids = sorted(prints)
    want = roots([(i, j) for i in ids for j in ids if j <= i and (prints[i] ^ prints[j]).bit_count() <= 3])
    assert {r.doc_id: r.component_id for r in rows} == want


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    blank = [r for r in rows if r.fp == 0]
    assert len(blank) == 5 and {r.component_id for r in blank} == {0}
    kept = simhash.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sum(r.doc_id == 100 for r in kept.collect()) == 1
    assert simhash.near_duplicates(no_docs).count() == 0


def test_row_numbers_survive_a_change_of_cores(spark, docs, monkeypatch, tmp_path):
    """The splits of a file scan follow the cores; here they change before each write."""
    twice = docs.union(docs.withColumn("doc_id", docs.doc_id + 1_000_000))
    twice.repartition(8).write.parquet(f"{tmp_path}/docs")
    rows = spark.read.parquet(f"{tmp_path}/docs")
    want = {r.component_id for r in simhash.near_duplicates(docs).select("component_id").distinct().collect()}
    keep, cores, old = simhash.written, iter([4, 2, 1, 3, 8] * 20), spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)

    def other_cores(df, label):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores))
        return keep(df, label)

    monkeypatch.setattr(simhash, "written", other_cores)
    try:
        kept = simhash.deduplicated(rows)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", 5)
        got = [r.doc_id for r in kept.select("doc_id").collect()]
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if old is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", old)
    assert len(got) == len(set(got)) and set(got) == want


def test_walks_over_many_tries_find_all_pairs_of_each_group():
    rng = np.random.default_rng(8)
    groups = [rng.integers(0, 2**63, (n, 4), dtype=np.int64).view(np.uint64) for n in (1, 2, 30, 7, 1, 60)]
    for g in groups[2:]:
        for i in range(1, len(g), 2):  # near ones, equal ones among them
            g[i] = g[i - 1]
            for bit in rng.integers(0, 256, rng.integers(0, 120)):
                g[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    words, starts = np.concatenate(groups), np.cumsum([0, *(len(g) for g in groups[:-1])])
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    a, b = simhash.wide_pairs(words, starts, 80)
    apart = lambda i, j: int(np.bitwise_count(words[i] ^ words[j]).sum())
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if owner[i] == owner[j] and apart(i, j) <= 80}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want and len(a) == len(want) > 40


def test_similar_texts_of_five_word_shingles(spark, planted_similar):
    """Exactly one document of each component stays, whatever the similarity on either side of 0.8."""
    rows, keep = planted_similar
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4)
    got = simhash.similar_removed(frame)
    assert got.columns == frame.columns and sorted(r.doc_id for r in got.collect()) == keep


@pytest.fixture(scope="module")
def planted_similar():
    rng = np.random.default_rng(21)
    texts = []
    for size, copies, most in ((30, 20, 3), (200, 60, 9), (80, 25, 6), (7, 10, 1)):
        base = rng.integers(0, 4000, size)
        for _ in range(copies):
            own = base.copy()
            for at in rng.integers(0, size, rng.integers(0, most + 1)):
                own[at] = rng.integers(0, 4000)
            texts.append(" ".join(f"w{x}" for x in own))
    texts += [texts[0], "one two", "ONE two", "three"]
    ids = rng.permutation(len(texts)).tolist()
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for t in texts]
    pairs = [(ids[i], ids[j]) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert any(80 <= 100 * len(a & b) / len(a | b) < 83 for a in sets for b in sets)
    root = roots(pairs)
    return [(i, t, "x") for i, t in zip(ids, texts)], sorted(i for i in ids if root.get(i, i) == i)
