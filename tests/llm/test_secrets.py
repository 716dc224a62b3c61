import random

import pytest

from tests.llm.conftest import ODD
from tidemark.llm import secrets


def test_fixed_forms_match_the_patterns(spark, sf_small, texts):
    for r in secrets.op3_secret_scan(spark, sf_small).collect():
        for name, value in secrets.brute_force(texts[r.doc_id]).items():
            assert r[name] == value, (r.doc_id, name)


def test_models_tell_random_strings_from_identifiers(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "customer account transaction database connection manager factory service handler request response builder order number value index".split()
    key = lambda: "".join(rng.choice(letters) for _ in range(32))
    name = lambda: "_".join(rng.choice(words) for _ in range(4))
    samples = spark.createDataFrame([(key(), True) for _ in range(300)] + [(name(), False) for _ in range(300)] + [(None, True), ("x", None)], "text string, random boolean")
    model = secrets.train(secrets.labelled_samples(samples))
    right = sum(secrets.ratio(model, key()) > 0 for _ in range(200)) + sum(secrets.ratio(model, name()) < 0 for _ in range(200))
    assert right >= 392  # 98 % of held-out strings
    base, added = secrets.find(f"see {key()} and {name()} password = '{key()}'", model)
    assert [s[0] for s in base] == ["assign"] and [s[0] for s in added] == ["random"]


def test_odd_texts(odd_docs):
    model = secrets.train(secrets.corpus_samples(odd_docs))
    rows = secrets.scan(odd_docs, model, ("doc_id", "fp")).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r.base_spans for r in rows if r.doc_id is not None and r.doc_id < len(ODD))


def test_empty_table_and_no_samples(no_docs):
    model = secrets.train(secrets.corpus_samples(no_docs))
    assert not model.any()
    assert secrets.scan(no_docs, model).count() == 0


@pytest.mark.parametrize("text,base", [
    ("token token: abcdef", [("assign", 6, 19)]), ("Api_Key='abc'", []), ("AKIA" + "A" * 15, []), ("AKIA" + "A" * 16, [("access", 0, 20)]),
    ("f" * 23, []), ("é" + "f" * 24 + "g", [("hex", 1, 25)]), ("tokſen = abcdefgh", []),
])
def test_single_matches(text, base):
    assert [s[:3] for s in secrets.base_spans(text)] == base


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
JOIN = {"snake": "_".join, "kebab": "-".join, "path": "/".join, "camel": lambda w: w[0] + "".join(x.capitalize() for x in w[1:])}


@pytest.fixture(scope="module")
def corpus_model(spark, docs):
    """Trained on half of the documents; the identifiers that it is tried on are made of words of the other half."""
    return secrets.train(secrets.corpus_samples(docs.where("doc_id % 2 = 0")), joined=True)


def test_added_spans_equal_brute_force(spark, docs, corpus_model):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["plain words", "é😀", "a_b-c/d", "".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 40)))]) for _ in range(rng.randint(0, 9)))) for i in range(600)]
    rows += [(10_000 + r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: [(s.start, s.end) for s in r.added_spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), corpus_model).collect()}
    assert got == {i: secrets.brute_random(t, corpus_model) for i, t in rows}
    assert sum(map(len, got.values())) > 500


def test_false_alarms_and_recall_by_length(docs, corpus_model):
    rng = random.Random(17)
    words = [w for r in docs.where("doc_id % 2 = 1").select("text").collect() for w in (r.text or "").split() if w.isascii() and w.isalpha() and len(w) > 1]
    hits = lambda strings: sum(bool(secrets.random_runs(s, corpus_model)) for s in strings) / len(strings)
    for style, join in JOIN.items():
        alarms = hits([join([rng.choice(words) for _ in range(rng.randint(1, 6))]) for _ in range(4000)])
        print(style, alarms)
        assert alarms < 0.01
    found = {n: hits(["".join(rng.choice(LETTERS) for _ in range(n)) for _ in range(2000)]) for n in (8, 12, 16, 20, 32, 64)}
    print(found)
    assert found[16] > 0.9 and min(found[n] for n in (20, 32, 64)) > 0.98
