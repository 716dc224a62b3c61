import collections
import math

import numpy as np

from tidemark.llm import lm


def double(model):
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64))
    return model


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = double(lm.Model(np.arange(lm.VOCABULARY + 1, 0, -1).astype(float)))
    sequences = [rng.integers(0, lm.VOCABULARY + 1, n) for n in (5, 9, 3, 7)]
    inputs, targets, fresh, text = lm.lanes_of(sequences, 2)
    start, real = np.zeros((lm.UNITS, inputs.shape[1])), text >= 0

    def loss():
        states, _, _ = model.forward(inputs, fresh, start)
        return model.losses(model.columns(states, real), targets[real]).sum()

    states, kept, _ = model.forward(inputs, fresh, start)
    _, d, ds = model.losses(model.columns(states, real), targets[real], gradient=True)
    whole = np.zeros((lm.UNITS, *real.shape))
    whole[:, real] = ds
    columns, dinputs, d["hidden"] = model.backward(inputs, fresh, kept, whole)
    d["inputs"] = np.zeros(model.inputs.shape)
    d["inputs"][:, columns] = dinputs
    for name in model.NAMES:
        weight = getattr(model, name)
        for flat in np.argsort(-np.abs(d[name]).ravel())[:4]:
            at = np.unravel_index(flat, weight.shape)
            weight[at] += 1e-2
            up = loss()
            weight[at] -= 2e-2
            down = loss()
            weight[at] += 1e-2
            assert math.isclose((up - down) / 2e-2, d[name][at], rel_tol=2e-2, abs_tol=1e-4), name


def test_probabilities_sum_to_one_and_state_is_carried():
    model = lm.Model(np.arange(lm.VOCABULARY + 1, 0, -1).astype(float))
    states = np.random.default_rng(2).normal(0, 1, (lm.UNITS, 1)).astype(np.float32)
    every = np.arange(lm.VOCABULARY + 1)
    assert math.isclose(np.exp(model.losses(np.repeat(states, len(every), 1), every)).sum(), 1, rel_tol=1e-4)
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, lm.VOCABULARY + 1, n) for n in (1, 200, 33, 64, 90)]
    alone = [lm.score_sequences(model, [s])[0] for s in sequences]
    assert np.allclose(lm.score_sequences(model, sequences), alone, rtol=1e-4)


def plain_score(model, ids):
    """log10 P of one text, token by token in 64-bit floats, with none of the operator's code but its weights."""
    w = {n: getattr(model, n).astype(np.float64) for n in model.NAMES}
    units, members = w["hidden"].shape[1], w["words"].shape[1]
    state, before, total = np.zeros(units), w["inputs"].shape[1] - 1, 0.0
    for token in (int(i) for i in ids):
        x, g = w["inputs"][:, before], w["hidden"] @ state
        update, reset = (1 / (1 + np.exp(-(x[k : k + units] + g[k : k + units]))) for k in (0, units))
        new = np.tanh(x[2 * units :] + reset * g[2 * units :])
        state = (1 - update) * new + update * state
        of_class = w["classes"] @ state + w["class_bias"]
        own = min(token // members, len(of_class) - 1)
        total += of_class[own] - np.log(np.exp(of_class).sum())
        if own < len(w["words"]):
            of_word = w["words"][own] @ state + w["word_bias"][own]
            total += of_word[token % members] - np.log(np.exp(of_word).sum())
        before = token
    return total / np.log(10)


def test_scores_match_a_plain_forward_pass(spark, docs, monkeypatch):
    """The score of every document by the trained weights: the plain pass, plus the smoothed shares of rare tokens."""
    made, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: made.append(train(*a)) or made[-1])
    rows = {r.doc_id: r.score for r in lm.scored(docs).collect()}
    texts = {r.doc_id: lm.tokens((r.text or "").encode()) for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if not lm.held_out(i) for w in t)
    best = sorted(counts, key=lambda w: (-counts[w], w))[: lm.VOCABULARY]
    ids = {w: k for k, w in enumerate(best)}
    rare = sum(counts.values()) - sum(counts[w] for w in best) + 0.5 * (len(counts) - len(best) + 1)
    short = sorted(texts, key=lambda i: (len(texts[i]), i))
    for i in [*short[:40], *short[-3:]]:
        model = plain_score(made[0], [ids.get(w, lm.VOCABULARY) for w in texts[i]])
        shares = math.fsum(math.log10((counts[w] + 0.5) / rare) for w in texts[i] if w not in ids)
        assert math.isclose(rows[i], model + shares, rel_tol=1e-4, abs_tol=1e-3), i


def test_base_scores_and_held_out_gain(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: lm.tokens((r.text or "").encode()) for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if not lm.held_out(i) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    rows = lm.scored(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        base = math.fsum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(counts[w] > 0 for w in t), total, lm.held_out(r.doc_id))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    own = [r for r in rows if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_odd_rows(odd_docs, no_docs):
    rows = lm.scored(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(math.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    assert lm.scored(no_docs).count() == 0


def test_rare_tokens_have_places_and_updates_are_frequent(monkeypatch):
    """1,536 tokens have a place of their own, and at most 4,096 tokens go into one update."""
    assert lm.VOCABULARY == lm.CLASSES * lm.MEMBERS >= 1536
    updates, backward = [], lm.Model.backward
    monkeypatch.setattr(lm.Model, "backward", lambda self, *a: updates.append(1) or backward(self, *a))
    rng = np.random.default_rng(4)
    pool = [rng.integers(0, lm.VOCABULARY + 1, 100) for _ in range(1500)]
    start = lm.Model(np.arange(lm.VOCABULARY + 1, 0, -1).astype(float))
    weights = start.inputs.copy()
    model, seen = lm.train_sequences(start, [pool])
    assert seen == 150_000 and len(updates) >= seen / 4096
    assert (model.inputs[:, 801:1536] != weights[:, 801:1536]).any(axis=0).all()


def test_scores_do_not_depend_on_the_partitioning(spark, docs, monkeypatch):
    """Several shards, dealt from one file or from many."""
    monkeypatch.setattr(lm, "SHARD", 30_000)
    few, many = ({r.doc_id: r.score for r in lm.scored(docs.repartition(n)).collect()} for n in (1, 7))
    assert few.keys() == many.keys() and np.allclose([few[i] for i in few], [many[i] for i in few], rtol=1e-3)
