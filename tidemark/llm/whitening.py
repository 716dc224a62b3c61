"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Two passes over the vectors give their whole-number sums and their centred scatter, added up by position
in the matrix; only sums for each pair of dimensions reach the driver. There the scatter P'VP = LL' is
factored with pivoting, and the columns of PL are rotated until they are orthogonal: their squared norms
are V's eigenvalues, the normalised columns its components. A third pass projects the vectors.

All sums are sums of whole numbers and exact, so neither the model nor a vector's deviation depends on
the order or partitioning of rows. Products are formed of 20-bit limbs of the entries less a whole number
near their mean, each product of limbs within the 53 bits in which a double is exact.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite entry, go; so do vectors of
another length than the most frequent one (the shorter of equally frequent ones). Entries whose x leaves
+-2**48 count as that. An empty table, a table of one distinct vector and vectors without entries have no
components and give no rows. Directions without variance (to double precision) are no components. A
deviation over 64 bits is null. Null ids, repeated ids and repeated rows stay; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

SCALE, SHIFT, WIDEST = 64.0, 1_000_000, 2.0**48
#: Bits of a limb, and rows of which products of limbs add up within 53 bits.
LIMB, ROWS = 20, 1 << 13
#: Components that are returned.
MOST = 32
#: Whitened values are rounded to multiples of 2**-BITS for the check of their covariance.
BITS = 36
#: Sweeps of rotations; convergence is quadratic and takes about ten.
SWEEPS = 60


@dataclass(frozen=True)
class Model:
    """n vectors with sums S of x; ``mean`` = S / n is near + rest, ``near`` whole; components are columns of unit length."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def near(self) -> np.ndarray:
        return np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The sums of x - near."""
        return np.array([s - self.n * round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite entries."""
    odd = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~odd)


def length_of(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors, 0 if there are none."""
    first = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return first["size"] if first else 0


def _matrices(batches, at: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The whole numbers x of up to ROWS vectors at a time."""
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            part = b.slice(start, ROWS)
            flat = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.clip(np.floor(SCALE * flat), -WIDEST, WIDEST).astype(np.int64) + SHIFT
            yield part, x.reshape(-1, d)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2**LIMB more than the one before, is ``y``; all but the last are not negative."""
    out = []
    while np.abs(y).max(initial=0) >> LIMB:
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y'y of at most ROWS whole-number rows, as Python's whole numbers."""
    parts = _limbs(y)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.decimal128(38, 0))])


def _summed(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in totals], pa.int32()), pa.array([j for _, j in totals], pa.int32()), pa.array([Decimal(int(s)) for s in totals.values()], SUMS.field("s").type)],
        schema=SUMS,
    )


def _totals(rows: DataFrame, run) -> dict[tuple[int, int], int]:
    """What the tasks have added up by position; as many numbers as a matrix of the dimensions has."""
    found = rows.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in found.collect()}


def _sums_of(d: int):
    def run(batches):
        n, s = 0, np.zeros(d, dtype=object)
        for _, x in _matrices(batches, 0, d):
            n += len(x)
            s += x.sum(axis=0).astype(object)
        if n:
            yield _summed({(-1, -1): n, **{(-1, i): s[i] for i in range(d)}})

    return run


def _scatter_of(near: np.ndarray, read=_matrices):
    d = len(near)

    def run(batches):
        total, s = np.zeros((d, d), dtype=object), np.zeros(d, dtype=object)
        seen = False
        for _, x in read(batches, 0, d):
            y = x - near
            total, s, seen = total + exact_products(y), s + y.sum(axis=0).astype(object), True
        if seen:
            yield _summed({**{(-1, i): s[i] for i in range(d)}, **{(i, j): total[i, j] for i in range(d) for j in range(i, d)}})

    return run


def _covariance(n: int, d: int, totals: dict[tuple[int, int], int], unit: int = 1) -> np.ndarray:
    """The covariance, divisor n, of which every entry is rounded once."""
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = Fraction(n * totals[i, j] - totals[-1, i] * totals[-1, j], n * n * unit * unit)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A with AA' = v, of as many columns as v has rank; the rows are in v's order."""
    d, rest, columns = len(v), v.copy(), []
    least = d * np.finfo(float).eps * max(v.diagonal(), default=0.0)
    for _ in range(d):
        p = int(np.argmax(rest.diagonal()))
        if rest[p, p] <= least:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0  # a pivot's row is done
        columns.append(column)
    return np.array(columns).T if columns else np.zeros((d, 0))


def one_sided_jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of ``a`` after rotating its columns until they are orthogonal, largest first."""
    a = a.copy()
    least = 4 * np.finfo(float).eps * np.sqrt(max(1, len(a)))
    for _ in range(SWEEPS):
        turned = False
        for p in range(a.shape[1] - 1):
            for q in range(p + 1, a.shape[1]):
                pp, qq, pq = a[:, p] @ a[:, p], a[:, q] @ a[:, q], a[:, p] @ a[:, q]
                if abs(pq) <= least * np.sqrt(pp * qq):
                    continue
                turned = True
                zeta = (qq - pp) / (2 * pq)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.sqrt(1 + t * t)
                a[:, p], a[:, q] = c * a[:, p] - c * t * a[:, q], c * t * a[:, p] + c * a[:, q]
        if not turned:
            break
    norms = (a * a).sum(axis=0)
    order = np.argsort(-norms, kind="stable")
    units = a[:, order] / np.sqrt(norms[order])
    signs = np.sign(units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])]) if units.shape[1] else np.zeros(0)
    return norms[order], units * signs


def fit(vectors: DataFrame, vector: str, d: int) -> Model | None:
    """The model of valid vectors of length ``d``; None if there are none."""
    column = vectors.select(vector)
    totals = _totals(column, _sums_of(d)) if d else {}
    if not totals:
        return None
    n, sums = totals[-1, -1], [totals[-1, i] for i in range(d)]
    near = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
    v = _covariance(n, d, _totals(column, _scatter_of(near)))
    eigenvalues, components = one_sided_jacobi(pivoted_cholesky(v))
    return Model(n, sums, eigenvalues, components, float(v.trace()))


def transformed(vectors: DataFrame, vector: str, model: Model, keep: tuple[str, ...] = ("vec_id",), most: int = MOST) -> DataFrame:
    """The columns ``keep``, deviation and w, the whitened coordinates of up to ``most`` components, largest first."""
    d, n, near, rest = len(model.sums), model.n, model.near, model.rest
    k = min(most, len(model.eigenvalues))
    turn = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])
    centre = np.array([float(Fraction(int(r), n)) for r in rest])

    def deviations(y: np.ndarray) -> list[int | None]:
        widest = (n * int(np.abs(y).max(initial=0)) + n) ** 2 * d
        z = n * (y if widest < 1 << 63 else y.astype(object)) - rest
        return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1).tolist()]

    def run(batches):
        for part, x in _matrices(batches, len(keep), d):
            y = x - near
            w = ((y - centre) @ turn).reshape(-1)
            ends = np.arange(len(y) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(deviations(y), pa.int64()), pa.ListArray.from_arrays(ends, w)], [*keep, "deviation", "w"])

    fields = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep]
    return vectors.select(*keep, vector).mapInArrow(run, ", ".join([*fields, "deviation long", "w array<double>"]))


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of ``w``, less the identity; w to 2**-BITS, sums exact."""

    def read(batches, at: int, d: int):
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                w = part.column(at).flatten().to_numpy(zero_copy_only=False)
                yield part, np.round(w * 2.0**BITS).astype(np.int64).reshape(-1, d)

    totals = _totals(whitened.select("w"), _scatter_of(np.zeros(k, dtype=np.int64), read))
    return float(np.abs(_covariance(n, k, totals, 1 << BITS) - np.eye(k)).max())


def whitened(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = MOST) -> DataFrame:
    """One row for each valid vector and component: ``key``, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kept = valid(rows.select(key, vector), vector)
    d = length_of(kept, vector)
    kept = kept.where(F.size(vector) == d)
    model = fit(kept, vector, d)
    k = min(most, len(model.eigenvalues)) if model else 0
    if not k:
        return spark.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = written(transformed(kept, vector, model, (key,), most), "whitening-rows")
    error = identity_error(done, model.n, k)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:k]])
    each = done.select(key, "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector of ``embeddings`` along its first 32 components."""
    return whitened(table(spark, sf_dir, "embeddings"))
