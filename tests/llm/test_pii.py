import math
import random
import re

from tests.llm.conftest import ODD
from tidemark.llm import pii

PIECES = ["a", "b.", "@", ".", "-", "1", "2 ", "12", "555", "+", "(", ")", " ", "é", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "+1 (504) 555-2652", "..", "😀", "255.", "\n", "4111-1111-", "_", "%"]


def listed(frame):
    rows = pii.spans(frame).select("doc_id", pii.listed(pii.F.col("base_spans")).alias("base"), pii.listed(pii.F.col("added_spans")).alias("added"))
    return {r.doc_id: (r.base, r.added) for r in rows.collect()}


def test_fixed_forms_match_the_plain_patterns(spark, texts):
    rng = random.Random(5)
    rows = dict(enumerate("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500)))
    rows |= {10_000 + i: t for i, t in texts.items()}
    got = listed(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4))
    assert {i: b for i, (b, _) in got.items()} == {i: pii.brute_force(t) for i, t in rows.items()}


def test_odd_texts_and_long_runs(spark, odd_docs, no_docs):
    long = {1: "1 " * 20_000, 2: "a@" + "b." * 20_000, 3: "1" * 100_000, 4: "a" * 100_000 + "@x.y", 5: "1." * 20_000, 6: "+1" + " " * 50_000 + "2"}
    got = listed(spark.createDataFrame(list(long.items()), "doc_id long, text string"))
    assert {i: b for i, (b, _) in got.items()} == {i: pii.brute_force(t) for i, t in long.items()}
    assert pii.spans(odd_docs).count() == odd_docs.count()
    assert {i: b for i, (b, _) in listed(odd_docs).items() if i is not None and i < len(ODD)} == {i: pii.brute_force(t) for i, t in enumerate(ODD)}
    assert pii.spans(no_docs).count() == 0


def test_estimation_finds_reliable_labelers():
    """Two labelers that agree with the truth, and one that guesses."""
    rng = random.Random(7)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.3
        right = lambda p: (1 if y else -1) if rng.random() < p else (-1 if y else 1)  # noqa: E731, B023
        vote = (right(0.95), right(0.9), right(0.5))
        counts[vote] = counts.get(vote, 0) + 1
    post = pii.estimate([("x", v, n) for v, n in sorted(counts.items())])
    assert post["x", (1, 1, -1)] > 0.9 and post["x", (-1, -1, 1)] < 0.1


def test_loose_forms_are_added_by_context(spark):
    rows = [(i, f"text {i} call me by phone: 555-{i:03d}-4567 today") for i in range(200, 260)]
    rows += [(i, f"the order number 555-{i:03d}-4567 was sent") for i in range(300, 330)]
    got = listed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(("local_phone" in a) == (i < 300) for i, (_, a) in got.items())


def test_redaction(spark):
    rows = [(1, "é write a@b.co or 10.1.2.3 now", 30), (2, "nothing", 7), (3, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.without_personal_data(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("é write [EMAIL] or [IP] now", 27), 2: ("nothing", 7), 3: (None, None)}


def test_the_classifier_decides_without_a_cue(spark):
    """Numbers in a list have no cue word, but all else is as in the ones that have one."""
    rows = [(i, f"text {i} her ssn 5{i}-12-3456 today") for i in range(10, 70)]
    rows += [(i, f"text {i} order number 9{i - 100}-00-0000 today") for i in range(110, 170)]
    rows += [(i, f"row {i} 5{i - 200}-12-3456 and so on") for i in range(210, 220)]
    got = listed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(("ssn" in a) == (i < 100 or i >= 200) for i, (_, a) in got.items())


def votes(kind, value, before, strict, known):
    """Regex, gazetteer and context, in plain Python."""
    digits = re.sub("[^0-9]", "", value)
    regex = 1 if strict else -1 if kind in pii.PATTERNS else 0
    if kind in ("email", "name"):
        gazetteer = int((kind, key(kind, value)) in known)
    elif kind == "iban":
        bare = value.replace(" ", "")
        number = int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4]))
        gazetteer = 1 if re.search(pii.IBAN_COUNTRIES, value) and number % 97 == 1 else -1
    else:
        good = {
            "ip": not re.search(pii.RESERVED, value), "card": re.search(pii.ISSUERS, digits), "phone": re.search(pii.COUNTRY_CODES, value),
            "ssn": not re.search("^(?:000|666|9)|-00-|-0000$", value), "local_phone": re.search(r"^\(?[2-9]", value),
        }
        gazetteer = 0 if good[kind] else -1
    context = 1 if re.search(pii.CUES[kind], before) else -1 if re.search(pii.ANTI, before) else 0
    n = len(value)
    return (regex, gazetteer, context), (min(n // 4, 12), 4 * len(digits) // n, int(bool(re.search(r"[\x20()-]", value))), int(bool(re.search(r"[:=]\x20*$", before))))


def key(kind, value):
    return value.rsplit("@", 1)[-1].lower() if kind == "email" else re.search(r"\x20([A-Z][a-z]+)", value)[1]


def plain(texts):
    """Added spans of each text, with loops and dictionaries only."""
    found = []
    for doc, text in enumerate(texts):
        base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in pii.brute_force(text).split(",") if s)]
        other = [(k, m.start(), m.end()) for k, p in pii.LOOSE.items() for m in re.finditer(p, text)]
        for k, p in pii.PLAIN.items():
            if k != "email":
                every = [(k, m.start(), m.end()) for m in re.finditer(p, text)]
                other += [s for s in every if s not in base and (k != "card" or 14 <= len(re.sub("[^0-9]", "", text[s[1] : s[2]])) <= 19)]
        meet = lambda a, b: a[1] < b[2] and b[1] < a[2]
        other = [s for s in other if not any(meet(s, b) for b in base) and not any(meet(s, o) and s[2] - s[1] < o[2] - o[1] for o in other)]
        found += [(doc, s, True) for s in base] + [(doc, s, False) for s in other]
    docs = {}
    for doc, (k, a, b), _ in found:
        if k in ("email", "name"):
            docs.setdefault((k, key(k, texts[doc][a:b])), set()).add(doc)
    known = {x for x, d in docs.items() if len(d) >= pii.RECURS}
    rows = [(doc, s, strict, *votes(s[0], texts[doc][s[1] : s[2]], texts[doc][max(0, s[1] - 40) : s[1]].lower(), strict, known)) for doc, s, strict in found]
    patterns = {}
    for _, s, _, vote, _ in rows:
        patterns[s[0], vote] = patterns.get((s[0], vote), 0) + 1
    post = pii.estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])
    out = {doc: [] for doc in range(len(texts))}
    for doc, s, strict, vote, more in rows:
        if strict:
            continue
        own = [(*v, *m) for _, t, _, v, m in rows if t[0] == s[0]]
        p = [post[s[0], v[:3]] for v in own]
        yes, no = math.fsum(p), math.fsum(1 - x for x in p)
        odds = math.log((yes + 1) / (no + 1))
        for i, x in enumerate((*vote, *more)):
            wide = len({v[i] for v in own}) + 1
            a, b = math.fsum(y for v, y in zip(own, p) if v[i] == x), math.fsum(1 - y for v, y in zip(own, p) if v[i] == x)
            odds += math.log((a + 1) / (yes + wide)) - math.log((b + 1) / (no + wide))
        if odds >= math.log(pii.ADD_AT / (1 - pii.ADD_AT)):
            out[doc].append(s)
    return {doc: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(s, key=lambda x: (x[1], pii.KINDS.index(x[0])))) for doc, s in out.items()}


def planted(n=900, seed=23):
    """(text, whether it holds a loose form that is personal data) of texts with true ones, decoys, and fixed forms."""
    rng, rows = random.Random(seed), []
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    names = ["Adler", "Brunet", "Castro", "Dupont", "Eriksen"]

    def iban():
        bare = "DE00" + digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97
        return f"DE{check:02d}{bare[4:]}"

    for i in range(n):
        area, number = rng.choice("23456789") + digits(2), digits(3) + "-" + digits(4)
        true = [
            f"please call {area}-{number} before noon", f"her mobile is ({area}) {number} and", f"my ssn is 1{digits(2)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} on file",
            f"pay to account {iban()} soon", f"yours, contact Dr {rng.choice(names)} Weber there", f"write to a{digits(3)}@mail{i % 7}.example.com or", f"tel +1 {area} {digits(3)} {digits(4)} now",
        ]
        false = [
            f"order {area}-{number} was sent", f"invoice 9{digits(2)}-00-{digits(4)} is paid", f"serial DE00{digits(18)} of the part", f"ticket {area}-{number} is closed",
            "nothing to see in this line", f"tracking 000-{rng.randint(10, 99)}-{digits(4)} lost",
        ]
        k = rng.randrange(len(true) + len(false))
        rows.append((f"row {i}: {(true + false)[k]}", k < 5) if k != 5 and k != 6 else (f"row {i}: {true[k]}", None))
    return rows


def test_added_spans_equal_a_plain_version(spark):
    texts = [t for t, _ in planted(400)] + [f"see 4111 1111 1111 1112 and Mr Adler {i}" for i in range(5)] + ["", "no data"]
    got = listed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    want = plain(texts)
    assert {i: a for i, (_, a) in got.items()} == want and sum(map(bool, want.values())) > 50


def test_precision_and_recall_on_planted_forms():
    rows = planted()
    added = plain([t for t, _ in rows])
    hit = [bool(added[i]) for i in range(len(rows))]
    right = sum(h and y is True for h, (_, y) in zip(hit, rows))
    recall, precision = right / sum(y is True for _, y in rows), right / max(1, sum(h for h, (_, y) in zip(hit, rows) if y is not None))
    print("recall", recall, "precision", precision)
    assert recall >= 0.9 and precision >= 0.9


def test_redaction_bears_columns_of_inner_names(spark):
    rows = [(1, "write to a.b@example.org now", "x", "y", "z", 28), (2, None, "x", "y", "z", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _own_text string, _text string, base_spans string, n_chars long")
    out = pii.without_personal_data(frame)
    assert out.columns == frame.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "write to [EMAIL] now", "x", "y", "z", 20), (2, None, "x", "y", "z", None)]
