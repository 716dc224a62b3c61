"""Scoring by a gated recurrent language model with a class-factored softmax, trained on the corpus.

1. Each chunk of documents sends its distinct tokens with their training counts to the range of the
   vocabulary that they fall in; a range sums them. N, V and the most frequent tokens follow from all ranges,
   whose number follows the bytes of all chunks' tokens, so that a task holds one of bounded size at a time.
2. The ranges answer each chunk with the tokens' counts, and every document becomes a sequence of vocabulary
   ids with its unigram base score.
3. One epoch of truncated backpropagation over all training documents: each task starts from the same
   weights, works through its documents in lanes that carry the state from window to window, and the tasks'
   weights are averaged by their tokens. ``rounds`` deals the documents into that many such epochs' parts, one
   after the other, each starting from the average before it.
4. Scoring carries the state from the first token of a document to its end, so it is the log-likelihood of
   the complete document.

The model is P(class | state) P(token | class, state). Tokens outside the vocabulary are one class, in which
a token has its smoothed training share, so unseen tokens have a probability too. Documents are dealt for
training to shards of about SHARD tokens by a hash of their ids, in the order of the hash, so the weights don't depend on
the number of tasks, files or cores (save for the last digits of sums). Weights number
``vocabulary * (4 * units + 1)`` about, whatever the corpus; a task returns one set of them.

Defined cases: a null text is empty and has only the end token; a null id counts as the text '' for
the split; with no training tokens every probability is uniform; repeated rows have the same score up to
rounding; an empty table gives no rows; texts are scored whole; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import REQUEST, REQUEST_SCHEMA, batch_of, batches_of, by_frequency, by_range, chunked, dealt, join_blobs, pack, pack_ids, pack_ranks, pack_rising, pack_strings, ranges_of, rows_of, split_blobs, squeeze, tidy, unpack, unpack_ids, unpack_ranks, unpack_rising, unpack_strings, unsqueeze
from tidemark.llm.common import partitions, table, written

#: The end of a text; no token has a space.
END = b" "
CLASSES, MEMBERS, UNITS = 32, 48, 16
VOCABULARY = CLASSES * MEMBERS
WINDOW, LANES, RATE, ROUNDS, SEED = 48, 85, 0.03, 2, 11
#: Lanes of scoring, where no weights change; training takes fewer, so that WINDOW * LANES tokens make an update.
SCORE_LANES = 512
#: Documents of which lanes are made at a time, by their tokens.
POOL = 1 << 22
#: Training tokens of a shard, which one task works through; so a round's number of shards follows the corpus.
SHARD = 4_000_000


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split() + [END]


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


CHUNKS = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("sequence", pa.binary()), ("tokens", pa.binary())])


def _collect(batches):
    """Chunks of documents as token numbers, with each distinct token and its training count."""

    def rows():
        for chunk, ids, texts in chunked(batches):
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            found = []
            for text in texts:
                words = tokens(text)
                found.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
            every = np.concatenate(found)
            lengths = np.array([len(f) for f in found], dtype=np.uint32)
            train = np.repeat([not held_out(i) for i in ids], lengths)
            ranks, order = by_frequency(every, len(numbers))
            counts = np.bincount(ranks[train], minlength=len(numbers)).astype(np.uint32)
            words = list(numbers)
            yield chunk, len(ids), join_blobs([pack_ids(ids), pack(lengths)]), join_blobs(pack_ranks(ranks)), join_blobs([pack_strings([words[i] for i in order.tolist()]), pack(counts)])

    yield from batches_of(rows(), CHUNKS)
    tidy()


def _ask(ranges: int):
    def run(batches):
        def rows():
            for chunk, data in rows_of(batches):
                words, counts = split_blobs(data)
                words, counts = unpack_strings(words), unpack(counts, np.uint32)
                where = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % ranges
                order = np.argsort(where, kind="stable")
                present, starts = np.unique(where[order], return_index=True)
                for p, a, b in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
                    own = order[a:b]
                    yield p, chunk, len(own), pack_strings([words[i] for i in own.tolist()]), join_blobs([pack(counts[own]), pack_rising(own.astype(np.uint32))])

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _totals(held: list[tuple]) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for r in held:
        counts, _ = split_blobs(r[4])
        for w, c in zip(unpack_strings(r[3]), unpack(counts, np.uint32).tolist()):
            total[w] = total.get(w, 0) + c
    return total


#: The chunk number of a part's own row.
TOTALS = -1


def _answer(vocabulary: int):
    """Training counts of the tokens that each chunk asks about, and a row with each range's totals and most frequent tokens."""

    def run(batches):
        def rows():
            for held in by_range(batches):
                total = _totals(held)
                for part, chunk, n, words, more in held:
                    counts = np.fromiter(map(total.__getitem__, unpack_strings(words)), dtype=np.uint64, count=n)
                    yield part, chunk, n, pack(counts), split_blobs(more)[1]
                known = [(w, c) for w, c in total.items() if c]
                best = sorted(known, key=lambda x: (-x[1], x[0]))[:vocabulary]
                sums = np.array([sum(c for _, c in known), len(known), *[c for _, c in best]], dtype=np.int64)
                yield 0, TOTALS, len(best), pack_strings([w for w, _ in best]), sums.tobytes()

        yield from batches_of(rows(), REQUEST_SCHEMA)
        tidy()

    return run


def _best(vocabulary: int):
    """(token, n, distinct): all ranges' totals under a null token, and the most frequent tokens of all.

    One task reads one row after the other, at most MOST_RANGES rows of ``vocabulary`` tokens whatever the corpus.
    """

    def run(batches):
        schema = pa.schema([("token", pa.binary()), ("n", pa.int64()), ("distinct", pa.int64())])
        total, distinct, found = 0, 0, []
        for data, more in rows_of(batches):
            sums = np.frombuffer(more, dtype=np.int64).tolist()
            total, distinct = total + sums[0], distinct + sums[1]
            found = heapq.nsmallest(vocabulary, [*found, *zip([-c for c in sums[2:]], unpack_strings(data))])
        yield batch_of([(None, total, distinct), *[(w, -c, 0) for c, w in found]], schema)

    return run


DOCUMENTS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, rare_sum double, ids binary"
DOCUMENTS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("rare_sum", pa.float64()), ("ids", pa.binary())])


def _numbered(sent, rare_total: float):
    """Documents as vocabulary ids, with the sums of log10 smoothed counts over all and over rare tokens."""

    def run(batches):
        def rows():
            for n, ids, sequence, words, found in rows_of(batches):
                names = unpack_strings(split_blobs(words)[0])
                ids, lengths = split_blobs(ids)
                ids, lengths, words = unpack_ids(ids, n), unpack(lengths, np.uint32).tolist(), unpack_ranks(split_blobs(sequence))
                known = np.fromiter((sent.value.get(w, VOCABULARY) for w in names), dtype=np.uint16, count=len(names))
                counts = np.zeros(len(names), np.float64)
                for a in found or []:
                    counts[unpack_rising(a["more"], np.uint32)] = unpack(a["data"], np.uint64)
                logs, end = np.log10(counts + 0.5), 0
                rare = np.where(known == VOCABULARY, logs - np.log10(rare_total), 0.0)
                for i, m in zip(ids, lengths):
                    w, end = words[end : end + m], end + m
                    yield i, held_out(i), m, int((counts[w] > 0).sum()), float(logs[w].sum()), float(rare[w].sum()), squeeze(known[w].tobytes())

        yield from batches_of(rows(), DOCUMENTS_SCHEMA)
        tidy()

    return run


class Model:
    """Weights of the gated unit and the two softmax layers, in 32-bit floats; the last axis runs over tokens or lanes."""

    NAMES = ("inputs", "hidden", "classes", "class_bias", "words", "word_bias")

    def __init__(self, counts: np.ndarray, seed: int = SEED):
        """``counts`` of the VOCABULARY ids, most frequent first, and of all other tokens."""
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(UNITS)
        self.inputs = rng.normal(0, scale, (3 * UNITS, VOCABULARY + 2)).astype(np.float32)  # the last is the start of a text
        self.hidden = rng.normal(0, scale, (3 * UNITS, UNITS)).astype(np.float32)
        self.classes = rng.normal(0, 0.1, (CLASSES + 1, UNITS)).astype(np.float32)
        self.words = rng.normal(0, 0.1, (CLASSES, MEMBERS, UNITS)).astype(np.float32)
        by_class = np.append(counts[:VOCABULARY].reshape(CLASSES, MEMBERS).sum(axis=1), counts[VOCABULARY]) + 0.5
        self.class_bias = np.log(by_class / by_class.sum()).astype(np.float32)
        share = counts[:VOCABULARY].reshape(CLASSES, MEMBERS) + 0.5
        self.word_bias = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def forward(self, ids: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """States (steps, units, lanes) before each token of ``ids`` (steps, lanes); ``fresh`` marks first tokens of texts."""
        steps, lanes = ids.shape
        kind = self.hidden.dtype
        states, before, inner = (np.empty((steps, UNITS, lanes), kind) for _ in range(3))
        gates = np.empty((steps, 3 * UNITS, lanes), kind)
        x, keep = self.inputs[:, ids], (~fresh).astype(kind)
        for t in range(steps):
            state = np.multiply(state, keep[t], out=before[t])
            g = self.hidden @ state
            zr = x[: 2 * UNITS, t] + g[: 2 * UNITS]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=gates[t, : 2 * UNITS])
            inner[t] = g[2 * UNITS :]
            z, n = gates[t, :UNITS], gates[t, 2 * UNITS :]
            np.multiply(gates[t, UNITS : 2 * UNITS], inner[t], out=n)
            n += x[2 * UNITS :, t]
            np.tanh(n, out=n)
            state = np.subtract(state, n, out=states[t])
            state *= z
            state += n
        return states, (gates, inner, before), state.copy()

    @staticmethod
    def columns(values: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The columns of (steps, rows, lanes) at the true places of ``real`` (steps, lanes)."""
        whole = values.transpose(1, 0, 2).reshape(values.shape[1], -1)
        return whole if real.all() else whole[:, real.ravel()]

    def losses(self, states: np.ndarray, targets: np.ndarray, gradient: bool = False):
        """log P of each target given its state (natural), and with ``gradient`` the derivatives of the sum."""
        own = np.minimum(targets // MEMBERS, CLASSES)
        order = np.argsort(own.astype(np.uint8), kind="stable")
        own, ordered, every = own[order], targets[order], np.arange(len(targets))
        s = states[:, order]
        logits = self.classes @ s + self.class_bias[:, None]
        logits -= logits.max(axis=0)
        found = logits[own, every]
        p = np.exp(logits, out=logits)
        total = p.sum(axis=0)
        found -= np.log(total)
        if gradient:
            p *= -1 / total
            p[own, every] += 1
            d = {"classes": p @ s.T, "class_bias": p.sum(axis=1), "words": np.zeros_like(self.words), "word_bias": np.zeros_like(self.word_bias)}
            ds = self.classes.T @ p
        ends = np.searchsorted(own, np.arange(CLASSES + 1)).tolist()
        for c in range(CLASSES):
            a, b = ends[c], ends[c + 1]
            if a == b:
                continue
            part, member = s[:, a:b], ordered[a:b] - c * MEMBERS
            q = self.words[c] @ part
            q += self.word_bias[c][:, None]
            q -= q.max(axis=0)
            hit = q[member, every[: b - a]]
            e = np.exp(q, out=q)
            total = e.sum(axis=0)
            found[a:b] += hit - np.log(total)
            if gradient:
                e *= -1 / total
                e[member, every[: b - a]] += 1
                d["words"][c], d["word_bias"][c] = e @ part.T, e.sum(axis=1)
                ds[:, a:b] += self.words[c].T @ e
        out = np.empty_like(found)
        out[order] = found
        if not gradient:
            return out
        back = np.empty_like(ds)
        back[:, order] = ds
        return out, d, back

    def backward(self, ids, fresh, kept, ds):
        """Derivatives of the gated unit's weights through one window; ``ds`` is (units, steps, lanes)."""
        gates, inner, before = kept
        steps, lanes = ids.shape
        dx = np.empty((3 * UNITS, steps, lanes), self.hidden.dtype)
        dhidden, keep = np.zeros_like(self.hidden), (~fresh).astype(self.hidden.dtype)
        carried = np.zeros((UNITS, lanes), self.hidden.dtype)
        for t in range(steps - 1, -1, -1):
            dh = ds[:, t] + carried
            z, r, n = gates[t, :UNITS], gates[t, UNITS : 2 * UNITS], gates[t, 2 * UNITS :]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before[t] - n) * z * (1 - z)
            dr = dn * inner[t] * r * (1 - r)
            dx[:UNITS, t], dx[UNITS : 2 * UNITS, t], dx[2 * UNITS :, t] = dz, dr, dn
            dg = np.concatenate([dz, dr, dn * r])
            dhidden += dg @ before[t].T
            carried = (dh * z + self.hidden.T @ dg) * keep[t]
        flat = ids.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ordered = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(ordered) != 0]))
        return ordered[starts], np.add.reduceat(dx.reshape(3 * UNITS, -1)[:, order], starts, axis=1), dhidden


def lanes_of(sequences: list[np.ndarray], most: int):
    """Texts laid end to end in lanes of nearly equal length.

    Returns inputs, targets (steps, lanes), which steps begin a text, which are padding, and for
    each target the number of its text.
    """
    sizes = np.array([len(s) for s in sequences])
    lanes = max(1, min(most, len(sequences), int(sizes.sum() // max(1, sizes.max())) + 1))
    load = np.zeros(lanes, dtype=np.int64)
    members: list[list[int]] = [[] for _ in range(lanes)]
    order = np.argsort(-sizes, kind="stable").tolist()
    heap = [(0, k) for k in range(lanes)]
    for i in order:
        n, k = heapq.heappop(heap)
        members[k].append(i)
        load[k] = n + sizes[i]
        heapq.heappush(heap, (n + int(sizes[i]), k))
    steps = int(load.max())
    inputs = np.full((steps, lanes), VOCABULARY + 1, np.uint16)
    targets, text = np.zeros((steps, lanes), np.int16), np.full((steps, lanes), -1, np.int32)
    fresh = np.zeros((steps, lanes), dtype=bool)
    for k, own in enumerate(members):
        at = 0
        for i in own:
            s = sequences[i]
            n = len(s)
            targets[at : at + n, k], text[at : at + n, k], fresh[at, k] = s, i, True
            inputs[at + 1 : at + n, k] = s[:-1]
            at += n
    return inputs, targets, fresh, text


def score_sequences(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole sequence of ids."""
    inputs, targets, fresh, text = lanes_of(sequences, SCORE_LANES)
    state, total = np.zeros((UNITS, inputs.shape[1]), model.hidden.dtype), np.zeros(len(sequences))
    for at in range(0, len(inputs), WINDOW):
        part = slice(at, at + WINDOW)
        states, _, state = model.forward(inputs[part], fresh[part], state)
        real = text[part] >= 0
        found = model.losses(model.columns(states, real), targets[part][real])
        total += np.bincount(text[part][real], weights=found.astype(np.float64), minlength=len(total))
    return total


def train_sequences(model: Model, pools, rate: float = RATE) -> tuple[Model, int]:
    """One pass of truncated backpropagation with Adagrad steps over pools of sequences; tokens seen."""
    squares = {n: np.full_like(getattr(model, n), 1e-2) for n in Model.NAMES}
    seen = 0

    def step(name, gradient, columns=None):
        weight, square = getattr(model, name), squares[name]
        if columns is None:
            square += gradient * gradient
            weight += rate * gradient / np.sqrt(square)
        else:
            square[:, columns] += gradient * gradient
            weight[:, columns] += rate * gradient / np.sqrt(square[:, columns])

    for sequences in pools:
        inputs, targets, fresh, text = lanes_of(sequences, LANES)
        state = np.zeros((UNITS, inputs.shape[1]), model.hidden.dtype)
        for at in range(0, len(inputs), WINDOW):
            part = slice(at, at + WINDOW)
            states, kept, state = model.forward(inputs[part], fresh[part], state)
            real = text[part] >= 0
            _, d, ds = model.losses(model.columns(states, real), targets[part][real], gradient=True)
            n = ds.shape[1]
            whole = np.zeros((UNITS, *real.shape), ds.dtype)
            whole[:, real] = ds
            columns, dinputs, dhidden = model.backward(inputs[part], fresh[part], kept, whole)
            scale = np.float32(1 / np.sqrt(n))
            for name, gradient in d.items():
                step(name, gradient * scale)
            step("hidden", np.clip(dhidden * scale, -5, 5))
            step("inputs", np.clip(dinputs * scale, -5, 5), columns)
            seen += n
    return model, seen


def _pools(batches, column: int, limit: int = POOL):
    """Lists of (row values, ids) with about ``limit`` tokens each."""
    held, size = [], 0
    for r in rows_of(batches):
        ids = np.frombuffer(unsqueeze(r[column]), dtype=np.uint16)
        held.append((r, ids))
        size += len(ids)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(documents: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after one epoch over the documents that aren't held out."""
    spark = documents.sparkSession
    schema = pa.schema([("n", pa.int64()), ("weights", pa.binary())])

    def trainer(sent, counts):
        def run(batches):
            model = Model(counts)
            if sent.value is not None:
                model.load(sent.value)
            model, seen = train_sequences(model, ([ids for _, ids in pool] for pool in _pools(batches, 0)))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([model.flat().tobytes()])], schema=schema)
            tidy()

        return run

    weights = None
    shards = max(1, -(-int(counts.sum()) // (rounds * SHARD)))
    hashed = documents.where(~F.col("held_out")).select(F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", F.lit(SEED)).alias("place"), "ids")
    for k in range(rounds):
        share = hashed.where(F.pmod("h", F.lit(rounds)) == k).repartitionById(shards, F.pmod("place", F.lit(shards)).cast("int"))
        share = share.sortWithinPartitions("place", "ids").select("ids")
        # the mean is taken weight by weight in Spark, so one set of weights reaches the driver
        sets = written(share.mapInArrow(trainer(spark.sparkContext.broadcast(weights), counts), "n long, weights binary"), f"lm-weights{k}")
        total = sets.agg(F.sum("n")).first()[0]
        if not total:
            continue
        summed = sets.repartition(max(1, min(partitions(spark), 16))).mapInArrow(_weighted, "at int, total binary")
        mean = np.zeros(len(Model(counts).flat()))
        for row in summed.toLocalIterator():
            mean += np.frombuffer(row["total"], dtype=np.float64)
        weights = (mean / total).astype(np.float32)
    model = Model(counts)
    return model if weights is None else model.load(weights)


def _weighted(batches):
    total = None
    for n, weights in rows_of(batches):
        own = n * np.frombuffer(weights, dtype=np.float32).astype(np.float64)
        total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["at", "total"])


def _score(sent, counts):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64())])

    def run(batches):
        model = Model(counts).load(sent.value)
        for pool in _pools(batches, 6):
            found = score_sequences(model, [ids for _, ids in pool]) / np.log(10)
            rows = [(*r[:5], r[5] + s) for (r, _), s in zip(pool, found.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        tidy()

    return run


def scored(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each document."""
    spark = docs.sparkSession
    parts = partitions(spark)
    chunks = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_collect, "chunk long, n int, ids binary, sequence binary, tokens binary"), "lm-chunks")
    # packed tokens have about a quarter of their bytes
    ranges = ranges_of(4 * (chunks.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0), parts)
    asked = dealt(chunks.select("chunk", "tokens").mapInArrow(_ask(ranges), REQUEST), parts, ranges)
    told = written(asked.mapInArrow(_answer(VOCABULARY), REQUEST), "lm-counts")
    sums = told.where(F.col("chunk") == TOTALS).select("data", "more").repartition(1).mapInArrow(_best(VOCABULARY), "token binary, n long, distinct long")
    total, distinct = (x or 0 for x in sums.where("token IS NULL").agg(F.sum("n"), F.sum("distinct")).first())
    best = sums.where("token IS NOT NULL").orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()  # the vocabulary's size
    ids = {bytes(r["token"]): k for k, r in enumerate(best)}
    counts = np.zeros(VOCABULARY + 1)
    counts[: len(best)] = [r["n"] for r in best]
    counts[VOCABULARY] = total - counts.sum()
    rare_total = counts[VOCABULARY] + 0.5 * (distinct - len(best) + 1)
    # one answer for each range at most
    found = told.where(F.col("chunk") != TOTALS).groupBy("chunk").agg(F.collect_list(F.struct("n", "data", "more")).alias("answers"))
    numbered = chunks.join(found, "chunk", "left").select("n", "ids", "sequence", "tokens", "answers")
    documents = written(numbered.mapInArrow(_numbered(spark.sparkContext.broadcast(ids), rare_total), DOCUMENTS), "lm-documents")
    model = train(documents, counts, rounds)
    rows = documents.mapInArrow(_score(spark.sparkContext.broadcast(model.flat()), counts), "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double")
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))).alias("base_score"), "score",
    )


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of ``documents`` by the model trained on those that aren't held out."""
    return scored(table(spark, sf_dir, "documents"))
