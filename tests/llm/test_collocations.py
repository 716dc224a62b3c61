"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import chunks, collocations
from tidemark.llm.transducers import Transducer, summed, united


def brute(rows, least, top=2000, width=5):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, width + 1):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in count.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if (i, j) != (0, len(p)):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        rows = []
        for p, a in candidates.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(frame, least, top=2000):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.collocations(frame, least, top=top).collect())


def test_equals_plain_counting_on_the_table(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = brute(rows, collocations.LEAST)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.op11_collocations(spark, sf_mid).collect())
    assert got == want and len(want) > 50


@pytest.mark.parametrize("least", [3, 8])
def test_small_chunks_and_ranges_and_a_short_list(spark, sf_small, monkeypatch, least):
    """Many chunks and ranges, repeated passages of all lengths, and a cut among ties."""
    monkeypatch.setattr(chunks, "RANGE_BYTES", 1 << 16)
    inner = collocations._read

    def small(batches):
        collocations.CHUNK_BYTES = 20_000
        yield from inner(batches)

    monkeypatch.setattr(collocations, "_read", small)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("lang", "text")
    rng = random.Random(least)
    words = [f"v{i}" for i in range(12)]
    extra = [(rng.choice(["en", None, "a b", ""]), " ".join(rng.choice(words + ["A", "a", "a", ".", ",\t", "!"]) for _ in range(rng.randrange(400)))) for _ in range(30)]
    frame = docs.unionByName(spark.createDataFrame(extra, "lang string, text string")).repartition(5)
    assert found(frame, least, 50) == brute([tuple(r) for r in frame.collect()], least, 50)


def test_odd_documents(spark, odd_docs, no_docs):
    assert found(odd_docs, 2) == brute([(r.lang, r.text) for r in odd_docs.collect()], 2)
    assert found(no_docs, 2) == []


def test_scores_are_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([("x", "p q", 3_000_000_000, [3_000_000_001, 3_000_000_000], [4_000_000_007, 3_000_000_000])], collocations.RESULT)
    totals = spark.createDataFrame([("x", 9_000_000_000_000)], "lang string, n long")
    keep, collocations.phrases = collocations.phrases, lambda *_: (rows, totals)
    try:
        row = collocations.collocations(rows).first()
    finally:
        collocations.phrases = keep
    assert (row.score, row.l, row.r) == (1000 * 3_000_000_000 * 9_000_000_000_000 // (3_000_000_001 * 4_000_000_007), 3_000_000_001, 4_000_000_007)


def random_rows(rng, n, width, labels):
    rows = rng.integers(1, labels, (n, width))
    for row in rows:
        row[rng.integers(1, width + 1) :] = 0
    return summed(rows, rng.integers(1, 9, n))


def test_transducers_count_prefixes_and_unite():
    rng = np.random.default_rng(3)
    parts, want = [], Counter()
    for _ in range(6):
        rows, counts = random_rows(rng, 300, 5, 6)
        parts.append(Transducer.from_bytes(Transducer.build(rows, counts).to_bytes()))
        for row, n in zip(rows.tolist(), counts.tolist()):
            row = [x for x in row if x]
            for k in range(1, len(row) + 1):
                want[tuple(row[:k] + [0] * (5 - k))] += n
    every, weights = united(parts, 5)
    assert dict(zip(map(tuple, every.tolist()), weights.tolist())) == dict(want)
    one = Transducer.build(every, collocations._residual(every, weights))
    asked = np.concatenate([every, rng.integers(1, 9, (200, 5))])
    assert one.composed(asked).tolist() == [want.get(tuple(r), 0) for r in asked.tolist()]
    none = Transducer.build(every[:0], weights[:0])
    assert none.composed(asked).tolist() == [0] * len(asked) and len(none.prefixes()[0]) == 0


def test_equal_ends_are_shared():
    rows = np.array([[i, 7, 8, 9] for i in range(1, 50)])
    levels = Transducer.build(rows, np.full(49, 2)).levels
    assert [len(v.degrees) for v in levels] == [1, 1, 1, 1]
