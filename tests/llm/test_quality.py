import collections
import random
import re

import numpy as np

from tidemark.llm import quality


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    mark = np.zeros(len(words), dtype=bool)
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            mark[i : i + 5] = True
    repeated, n = int(mark.sum()), len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


def test_statistics_match_a_plain_count(docs, texts, odd_docs):
    for frame in (docs, odd_docs):
        known = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
        for r in quality.statistics(frame).collect():
            if r.doc_id is not None:
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(known[r.doc_id]), r.doc_id


def mcd(x, share, steps):
    """The same concentration steps in numpy."""
    best = None
    mad = 1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)
    floor = np.diag(np.array(quality.FLOORS, float) ** 2)
    for m, c in ((np.median(x, axis=0), np.diag(mad**2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(steps):
            y = x - m
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(c + floor), y)
            bins = np.floor(64 * np.log2(d + 2.0**-20)).astype(int)
            near = x[bins <= np.percentile(bins, 100 * share)]
            m, c = near.mean(axis=0), np.cov(near.T, bias=True)
        det = np.linalg.slogdet(c + floor)[1]
        if best is None or det < best[0]:
            best = (det, m, c + floor)
    _, m, c = best
    y = x - m
    return np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y) / quality.consistency(share)


def test_estimates_match_a_plain_version(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        junk = i % 12 == 0
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + ("%%%" if junk else "") for _ in range(rng.randint(30, 80))]
        rows.append((i, " ".join(words), "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = quality.statistics(docs, ("doc_id", "lang", "source"))
    x = {r.doc_id: [r[a] for a in quality.AXES] for r in quality.vectors(stats, 240).collect()}
    found = {r.doc_id: r for r in quality.judged(docs).collect()}
    ids = sorted(x)
    want = mcd(np.array([x[i] for i in ids], float), quality.KEEP_SHARE, quality.STEPS)
    assert np.allclose([found[i].distance2 for i in ids], want, rtol=1e-6)
    assert {i for i in found if not found[i].kept} == {i for i in range(240) if i % 12 == 0}


def test_filter_keeps_columns_and_bears_odd_rows(odd_docs, no_docs):
    kept = quality.filtered(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() <= odd_docs.count()
    assert quality.judged(no_docs).count() == 0


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.487729) < 1e-5
