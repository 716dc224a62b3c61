"""Secret scan: fixed-form credentials, and random strings found by character Markov models.

Two first-order character models are trained from labelled samples: strings known to be random
(label true) and ordinary identifiers (label false). A run of RUN_MIN or more key characters is reported
as a ``random`` span when its log-likelihood ratio between the two models is above a limit for its length:
ODDS, the odds that a run must overcome, and TAIL standard deviations above what ordinary identifiers of
that length have. Both moments follow from the samples. A run without a letter is a number and isn't
reported. The transition counts of all samples are summed by
Spark; what reaches the driver is one count per pair of characters and label, at most 2 * 97 * 97 rows
whatever the size of the corpus.

Defined cases: a null text is empty and has no spans; texts are scanned whole; with no samples of
either label the models are equal, so nothing is added; repeated rows give repeated results;
further columns of the documents are ignored by :func:`scan` except those that it is asked to keep.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Fixed-form kinds in the order in which they are listed for spans that start together.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
#: Runs of so many key characters or more are judged by the models.
RUN_MIN = 8
#: Least ratio (in nats) of a random run, and standard deviations that it lies above those of ordinary identifiers.
ODDS, TAIL = 12.0, 6.0
#: Symbols of the models: the edge of a string, the printable ASCII characters, and any other one.
SYMBOLS = 97
SPAN_SCHEMA = "array<struct<kind:string,start:int,end:int>>"


def _marks(characters: str) -> bytes:
    return bytes(120 if chr(i) in characters else 32 for i in range(256))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX_MARKS, _RUN_MARKS = _marks("0123456789abcdef"), _marks(_ALNUM + "+/_=-")
_CODES = np.array([0 if i == 10 else i - 31 if 32 <= i < 127 else 96 for i in range(256)], dtype=np.int32)


def base_spans(text: str, data: bytes | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the fixed-form matches, by start and then kind; offsets in code points."""
    data = text.encode() if data is None else data
    found = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if b"AKIA" in data:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    if b"x" * HEX_MIN in data.translate(_HEX_MARKS):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= HEX_MIN]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _blanked(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, start, end, _ in spans:
        if end > at:
            out += [text[at : max(at, start)], " " * (end - max(at, start))]
            at = end
    return "".join(out) + text[at:]


def _pairs(data: bytes) -> np.ndarray:
    """Counts of neighbouring symbols in newline-separated strings."""
    codes = _CODES[np.frombuffer(b"\n" + data + b"\n", dtype=np.uint8)]
    return np.bincount(codes[:-1] * SYMBOLS + codes[1:], minlength=SYMBOLS * SYMBOLS)


_GAPS = bytes(i if chr(i) in _ALNUM + "+/_=-" else 10 for i in range(256))


def _count(batches):
    counts = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                data = text.encode()
                spans = base_spans(text, data)
                if spans:
                    counts[1] += _pairs("\n".join(dict.fromkeys(s[3] for s in spans)).encode())
                    data = _blanked(text, spans).encode()
                counts[0] += _pairs(data.translate(_GAPS))
    counts[:, 0] = 0  # between gaps
    label, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label == 1), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], ["random", "pair", "n"])


def corpus_samples(docs: DataFrame) -> DataFrame:
    """(random, pair, n): symbol-pair counts of the corpus' own labelled samples.

    The values of fixed-form matches are samples of random strings; the identifiers in the rest of
    every text are samples of ordinary ones.
    """
    return docs.select("text").mapInArrow(_count, "random boolean, pair int, n long").groupBy("random", "pair").agg(F.sum("n").alias("n"))


def _count_labelled(batches):
    for b in batches:
        counts = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
        for text, random in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text is not None and random is not None:
                counts[int(random)] += _pairs(text.encode().replace(b"\n", b" "))
        label, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label == 1), pa.array(pair.astype(np.int32)), pa.array(counts[label, pair])], ["random", "pair", "n"])


def labelled_samples(samples: DataFrame) -> DataFrame:
    """(random, pair, n) of a frame of samples with columns text and random (boolean)."""
    return samples.select("text", "random").mapInArrow(_count_labelled, "random boolean, pair int, n long").groupBy("random", "pair").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Models:
    """log P_random(b | a) - log P_ordinary(b | a) by symbol pair, and its mean and deviation over ordinary identifiers' steps."""

    table: np.ndarray
    mean: float
    deviation: float

    def any(self) -> bool:
        """Whether the two models differ."""
        return bool(self.table.any())

    def limit(self, length):
        """Least ratio of a run of ``length`` characters that is reported."""
        steps = length + 1
        return np.maximum(ODDS, steps * self.mean + TAIL * self.deviation * np.sqrt(steps))


def _joined(counts: np.ndarray) -> np.ndarray:
    """Counts of words to which those of words joined to identifiers are added: a_b, a-b, a/b and aB.

    Where a word ends and the next begins is known from the counts at their edges; for aB the first letters
    are taken to be followed as elsewhere.
    """
    ends, begins = counts[:, 0].copy(), counts[0].copy()
    out = counts.copy()
    for mark in "_-/":
        at = _CODES[ord(mark)]
        out[:, at] += ends
        out[at] += begins
    low, high = (np.array([_CODES[ord(c)] for c in alphabet]) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    share = begins[low] / max(1, begins[low].sum())
    out[:, high] += np.outer(ends, share)
    out[high] += counts[low] * (begins[low] / np.maximum(1, counts[low].sum(axis=1)))[:, None]
    return out


def train(counts: DataFrame, smoothing: float = 0.5, prior: float = 4.0, joined: bool = False) -> Models:
    """The models of the samples' counts; ``joined`` tells that ordinary samples are words, of which identifiers are made.

    Pairs back off to the frequency of their second symbol with the weight of ``prior`` samples.
    """
    table_ = np.zeros((2, SYMBOLS, SYMBOLS))
    for random, pair, n in counts.collect():  # at most 2 * SYMBOLS ** 2 rows
        table_[int(random)].flat[pair] = n
    if joined:
        table_[0] = _joined(table_[0])
    single = table_.sum(axis=1, keepdims=True) + smoothing
    single /= single.sum(axis=2, keepdims=True)
    p = np.log((table_ + prior * single) / (table_.sum(axis=2, keepdims=True) + prior))
    table, total = p[1] - p[0], max(1.0, table_[0].sum())
    mean = float((table_[0] * table).sum() / total)
    return Models(table, mean, math.sqrt(max(0.0, float((table_[0] * table * table).sum() / total) - mean * mean)))


def ratio(model: Models, run: str) -> float:
    """Log-likelihood ratio of a string, in nats; above 0 it looks random."""
    codes = _CODES[np.frombuffer(b"\n" + run.encode() + b"\n", dtype=np.uint8)]
    return math.fsum(model.table[codes[:-1], codes[1:]])


_IS_RUN = np.frombuffer(_RUN_MARKS, dtype=np.uint8) == 120


def random_runs(text: str, model: Models) -> list[tuple[int, int]]:
    """Start and end, in code points, of the runs whose ratio reaches their limit; all runs of a text are judged at once."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_RUN[data], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= RUN_MIN
    start, end = start[long], end[long]
    if not len(start):
        return []
    codes = _CODES[data]
    sums = np.concatenate([[0.0], np.cumsum(model.table[codes[:-1], codes[1:]])])
    score = sums[end - 1] - sums[start] + model.table[0, codes[start]] + model.table[codes[end - 1], 0]
    out = []
    for k in np.flatnonzero(score >= model.limit(end - start) - 1e-3).tolist():  # sums of long texts are rounded
        a, b = int(start[k]), int(end[k])
        run = data[a:b].tobytes().decode()
        if re.search("[A-Za-z]", run) and ratio(model, run) >= model.limit(b - a):
            at = len(data[:a].tobytes().decode())
            out.append((at, at + b - a))
    return out


def find(text: str | None, model: Models) -> tuple[list, list]:
    """(fixed-form spans, spans that the models add), each (kind, start, end)."""
    text = text or ""
    spans = base_spans(text)
    rest = _blanked(text, spans) if spans else text
    return [s[:3] for s in spans], [("random", a, b) for a, b in random_runs(rest, model)]


def scan(docs: DataFrame, model: Models, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and, per document, base_spans and added_spans: arrays of (kind, start, end)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SYMBOLS ** 2 numbers
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [find(t, sent.value) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*keep, "base_spans", "added_spans"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col("text")).mapInArrow(run, ", ".join([*fields, f"base_spans {SPAN_SCHEMA}", f"added_spans {SPAN_SCHEMA}"]))


def listed(spans):
    """kind:start:end of each span, comma-joined by start and then kind."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; the models learn from the same corpus."""
    docs = table(spark, sf_dir, "documents")
    rows = scan(docs, train(corpus_samples(docs), joined=True))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.concat("base_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_random"),
    )


def brute_random(text: str | None, model: Models) -> list[tuple[int, int]]:
    """The random runs of one text, run by run; for tests."""
    text = text or ""
    rest = _blanked(text, base_spans(text))
    found = re.finditer(rf"[A-Za-z0-9+/_=-]{{{RUN_MIN},}}", rest)
    return [m.span() for m in found if any(c.isalpha() for c in m[0]) and ratio(model, m[0]) >= max(ODDS, (len(m[0]) + 1) * model.mean + TAIL * model.deviation * math.sqrt(len(m[0]) + 1))]


def brute_force(text: str | None) -> dict:
    """The fixed-form results of one text, straight from the patterns; for tests."""
    text, spans = text or "", []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS[:3]} | {"base_sha256": hashlib.sha256(base.encode()).hexdigest()}
