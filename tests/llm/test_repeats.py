import collections
import random

import numpy as np
import pytest

from tidemark.llm import substrings, suffixes


def brute_words(docs, k):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, w in split:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            least[key] = min(least.get(key, 1 << 62), 1 << 61 if i is None else i)
    out = collections.Counter()
    for i, w in split:
        gone = np.zeros(len(w), dtype=bool)
        for a in range(len(w) - k + 1):
            if least[tuple(w[a : a + k])] < (1 << 61 if i is None else i):
                gone[a : a + k] = True
        out[i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


def brute_bytes(docs, length):
    counts = collections.Counter()
    for _, t in docs:
        b = (t or "").encode()
        counts.update(b[a : a + length] for a in range(len(b) - length + 1))
    out = collections.Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for a in range(len(b) - length + 1):
            if counts[b[a : a + length]] > 1:
                gone[a : a + length] = True
        out[i, len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    return out


def corpus(seed, alphabet, n=70):
    rng = random.Random(seed)
    line = lambda k: [rng.choice(alphabet) for _ in range(k)]
    shared, docs = [line(rng.randint(5, 60)) for _ in range(6)], []
    for i in range(n):
        w = line(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at, s = rng.randint(0, len(w)), rng.choice(shared)
            a = rng.randint(0, len(s))
            w[at:at] = s[a : a + rng.randint(0, 60)]
        docs.append((rng.choice([i, i, i, None, 7]), " ".join(w)))
    return docs + [(900, None), (901, ""), (902, docs[0][1]), (902, docs[0][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_word_spans_equal_brute_force(spark, seed):
    docs = corpus(seed, ["a", "b", "c", "é", "dd"])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(frame, 6).collect())
    assert got == brute_words(docs, 6)


@pytest.mark.parametrize("seed,length,prime", [(3, 40, 5), (4, 60, 7), (5, 31, 5)])
def test_byte_strings_equal_brute_force(spark, seed, length, prime):
    docs = corpus(seed, ["a", "b", "é"])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = suffixes.without_repeats(frame, length, prime).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows)
    assert got == brute_bytes(docs, length)
    assert all(sum(s.n_bytes for s in r.spans) == r.n_removed for r in rows)


def test_passages_go_from_400_bytes_on(spark):
    """Passages of 55 words in two documents each, with different bytes on both sides: by bytes, not by words, 399 stay and 400 go."""
    rng, docs = random.Random(10), []
    for i, size in enumerate([271, 330, 394, 399, 400, 401, 460]):
        words = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(55)]
        passage = " ".join([*words[:-1], words[-1] + "x" * (size - 55 * 4 + 1)])
        assert len(passage) == size
        around = ["".join(rng.choices("ijklmnop", k=rng.randint(50, 900))) for _ in range(4)]
        docs += [(2 * i, around[0] + "\n" + passage + "\n" + around[1]), (2 * i + 1, around[2] + " " + passage + "\t" + around[3])]
    rows = suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in rows} == {d: n for i, n in enumerate([0, 0, 0, 0, 400, 401, 460]) for d in (2 * i, 2 * i + 1)}
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == brute_bytes(docs, 400)


def test_edges_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """Under the first hashes all edges share a few hundred; no word may be lost by that, and none may stay."""
    plain = substrings.Edges.__init__

    def forged(self, ids, texts, k, salt=0):
        keep = substrings.shingle_hashes
        substrings.shingle_hashes = (lambda h, n: keep(h, n) % np.uint64(300) << np.uint64(55)) if salt == 0 else keep
        try:
            plain(self, ids, texts, k, salt)
        finally:
            substrings.shingle_hashes = keep

    # the tasks get the forged class with the closure
    ask, fold = substrings._ask, substrings._pack_edges

    def with_forged(make):
        def made(*args):
            run = make(*args)

            def task(batches):
                substrings.Edges.__init__ = forged
                try:
                    yield from run(batches)
                finally:
                    substrings.Edges.__init__ = plain

            return task

        return made

    monkeypatch.setattr(substrings, "_ask", with_forged(ask))
    monkeypatch.setattr(substrings, "_pack_edges", with_forged(fold))
    docs = corpus(6, ["a", "b", "c", "é", "dd"])
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 6).collect())
    assert got == brute_words(docs, 6)


def test_pieces_compact_to_paths(spark, monkeypatch):
    """A passage that is cut into several pieces at its source is one path."""
    monkeypatch.setattr(substrings, "BLOCK", 8)
    block = substrings._pack_edges

    def cut(*args):
        run = block(*args)

        def task(batches):
            substrings.BLOCK = 8
            yield from run(batches)

        return task

    monkeypatch.setattr(substrings, "_pack_edges", cut)
    passage = " ".join(f"w{i}" for i in range(50))
    docs = [(1, "x y " + passage), (2, passage + " z"), (3, "q " + passage)]
    rows = {r.doc_id: r for r in substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()}
    assert [(s.first_word, s.n_words, s.source, s.source_word) for s in rows[2].spans] == [(0, 50, 1, 2)]
    assert [(s.first_word, s.n_words, s.source, s.source_word) for s in rows[3].spans] == [(1, 50, 1, 2)]
    assert rows[2].kept == "z" and rows[3].kept == "q" and rows[1].n_removed == 0


def test_strings_that_share_a_name_keep_their_bytes(spark, monkeypatch):
    """64-bit names are forged to be equal; the further bits decide."""
    plain = suffixes.names

    def forged(make):
        def made(*args):
            run = make(*args)

            def task(batches):
                suffixes.names = lambda data, starts, length: plain(data, starts, length) % np.uint64(50) << np.uint64(58)
                try:
                    yield from run(batches)
                finally:
                    suffixes.names = plain

            return task

        return made

    for name in ("_ask", "_stretches", "_remove"):
        monkeypatch.setattr(suffixes, name, forged(getattr(suffixes, name)))
    docs = corpus(7, ["a", "b", "é"])
    rows = suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 40, 5).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in rows) == brute_bytes(docs, 40)


def test_prints_are_polynomials_modulo_the_prime():
    prime, prints = 2**61 - 1, suffixes.Prints(987654321987654321987654321)
    data = np.random.default_rng(3).integers(0, 256, 3000).astype(np.uint8)
    starts = np.array([0, 5, 6, 2000, 2600])
    want = [sum((int(c) + 1) * pow(prints.point, i, prime) for i, c in enumerate(data[s : s + 400])) % prime for s in starts.tolist()]
    assert prints.of(data, starts, 400).tolist() == want


@pytest.mark.parametrize("many", [False, True])
def test_many_ranges_and_chunks(spark, monkeypatch, many):
    """More ranges than parts, and several chunks in a task."""
    docs = corpus(8, ["a", "b", "c", "é"], 200)
    if many:
        monkeypatch.setattr(substrings, "ranges_of", lambda size, parts: 61)
        monkeypatch.setattr(suffixes, "ranges_of", lambda size, parts: 61)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 400)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 400)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(frame, 6).collect()) == brute_words(docs, 6)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.without_repeats(frame, 40, 5).collect()) == brute_bytes(docs, 40)


def test_crowded_chunks_are_checked_in_turns(spark, monkeypatch):
    """Nearly all claims are on the texts of the first chunk; no turn gets them all, and all are checked."""
    monkeypatch.setattr(substrings, "CLAIMS", 3)
    docs = corpus(9, ["a", "b", "c", "é"], 150)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(frame, 6).collect())
    assert got == brute_words(docs, 6)


def test_sources_that_share_an_id(spark):
    """Edges that follow each other at the coordinates of an id, but in two documents that have it."""
    docs = [(7, "q q q q q a b c d e f z"), (7, "r r r r r r b c d e f g"), (9, "a b c d e f g")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(frame, 6).collect())
    assert got == brute_words(docs, 6) and got[9, 7, 7, ""] == 1


@pytest.mark.parametrize("prime", [2, 3, 5, 7, 13, 17])
def test_difference_cover_has_every_difference(prime):
    cover, period = suffixes.difference_cover(prime), prime * prime + prime + 1
    assert len(cover) == prime + 1 and {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_names_in_pieces(monkeypatch):
    data = np.random.default_rng(0).integers(0, 3, 5000).astype(np.uint8)
    starts = np.unique(np.random.default_rng(1).integers(0, 4900, 300))
    whole = suffixes.names(data, starts, 100)
    monkeypatch.setattr(suffixes, "PIECE", 128)
    assert (suffixes.names(data, starts, 100) == whole).all()


def test_odd_rows(odd_docs, no_docs):
    assert substrings.without_repeats(odd_docs).count() == odd_docs.count()
    assert suffixes.without_repeats(odd_docs).count() == odd_docs.count()
    assert substrings.without_repeats(no_docs).count() == 0
    assert suffixes.without_repeats(no_docs).count() == 0
