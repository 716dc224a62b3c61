import random

from tidemark.llm import decontaminate as dc


def brute(docs, items):
    found = {}
    for i, text in docs:
        w = dc.words(text)
        for k, item in items:
            v = dc.words(item)
            if v and w:
                n = min(len(v), len(w))
                best = max(dc.similarity(dc.shingle_counts(w[a : a + n]), dc.shingle_counts(v)) for a in range(len(w) - n + 1))
                if best >= dc.THRESHOLD:
                    found[i, k] = round(best, 6)
    return found


def cases():
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(n))) for k, n in enumerate((3, 4, 5, 8, 15, 15, 30, 60))] + [(50, ""), (51, None), (52, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    docs = []
    for i in range(400):
        w = line(rng.randint(0, 60))
        if i % 2:
            v = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if v:
                    v[rng.randrange(len(v))] = "x%d" % i
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in v]
        docs.append((i, "\t".join(w)))
    return docs, items


def test_matches_equal_brute_force(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40
    for block in (dc.ITEMS, 3):
        got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in dc.matches(d, b, block).collect()}
        assert got == want
    clean = {r.doc_id for r in dc.decontaminated(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_multi_index_finds_every_fingerprint_in_the_radius():
    rng = random.Random(13)
    items = [(k, " ".join("w%d" % rng.randrange(500) for _ in range(20))) for k in range(40)]
    index = dc.Index(items)
    prints = index.prints.copy()
    for k in range(len(prints)):
        for bit in rng.sample(range(64), rng.randint(0, 26)):
            prints[k] ^= dc.np.uint64(1 << bit)
    one = dc.np.zeros(len(prints), int)
    window, item = dc.Blocks(one, index.prints).near(one, prints)
    want = {(i, j) for i in range(40) for j in range(40) if int(prints[i] ^ index.prints[j]).bit_count() <= dc.RADIUS}
    assert set(zip(window.tolist(), item.tolist())) == want


def test_large_buckets_find_the_same(monkeypatch):
    """Buckets of two items and more go through the multi-index, and few pairs are compared at a time."""
    docs, items = cases()
    items += [(100 + k, t) for k, (_, t) in enumerate(items)] + [(200 + k, f"{t} w1") for k, (_, t) in enumerate(items) if t]
    want = [dc.Index(items).search(t) for _, t in docs]
    monkeypatch.setattr(dc, "LARGE", 1)
    monkeypatch.setattr(dc, "PAIRS", 5)
    index = dc.Index(items)
    assert any(b.blocks for by_size in index.buckets.values() for b in by_size.values())
    assert [index.search(t) for _, t in docs] == want
    assert {(i, items[k][0]): round(s, 6) for (i, _), found in zip(docs, want) for k, s, _, _ in found} == brute(docs, items)


def test_few_candidates_for_each_window(docs):
    """5,000 items, most of them passages of the documents: a window is compared with a few, and every passage is found."""
    rng, texts = random.Random(5), [t for t in (r.text for r in docs.collect()) if t and len(t.split()) > 60]
    items = []
    for k in range(5000):
        w = rng.choice(texts).split()
        at = rng.randrange(len(w) - 40)
        items.append((k, " ".join(w[at : at + 40])))
    index, windows, pairs, compared = dc.Index(items), 0, 0, 0
    for t in texts[:100]:
        for grams, starts, m, _, buckets, which in index.named(dc.words(t)):
            windows += len(set(starts.tolist()))
            compared += int((buckets.ends - buckets.starts)[which].sum())
            pairs += len(index.candidates(grams, starts, m, buckets, which)[0])
    print("windows", windows, "compared", compared / windows, "candidates", pairs / windows)
    assert windows and compared / windows < 500 and pairs / windows < 100


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "same words here again"), (None, "no id at all"), (2, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.matches(odd_docs, items).collect()]
    assert sorted(got, key=str) == sorted([(100, 1), (100, 1), (None, None)], key=str)
    clean = dc.decontaminated(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count() - 3
    none = items.where("item_id = 9")
    assert dc.matches(odd_docs, none).count() == 0 and dc.decontaminated(odd_docs, none).count() == odd_docs.count()
    assert dc.matches(no_docs, items).count() == 0
