"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions only.

Every document gets a vector of transformed statistics. Per language and source a minimum-covariance-
determinant estimate is fitted: from two deterministic starts (coordinate medians with absolute
deviations, and plain moments) a fixed number of concentration steps keep the fraction ``keep_share``
of the rows that are nearest to the current centre; the start with the smaller determinant wins. A
document is rejected when its squared Mahalanobis distance exceeds the chi-square quantile of
``tail``. Statistics are whole numbers (thousandths), so sums and quantiles don't depend on the order
of rows, and the exact quantile of a group needs memory for the distinct values only.

Sources with fewer than ``least`` documents share one group per language, and languages whose shared
group is still that small share one more. The table of estimates has one row per group: it is
broadcast up to BROADCAST_GROUPS rows, beyond that it is joined by a shuffle that keeps hot groups apart.

Defined cases: null and blank texts have no words and fail the base rules; a null language or source
is a value of its own; repeated rows are judged alike; an empty table gives no rows; texts are used
whole; further columns are ignored by :func:`statistics` except those that it is asked to keep.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CHARS, lookup, table, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Share of the rows that a concentration step keeps, number of steps, least rows of a group, and the tail of the chi-square cut.
KEEP_SHARE, STEPS, LEAST, TAIL = 0.75, 3, 50, 1e-6
#: Least standard deviation of each statistic, in thousandths: what the rounding and short texts alone may cause.
FLOORS = (40, 300, 80, 50)
#: Words of the group's mean length that are mixed into each text's mean word length, which steadies short texts.
PRIOR_WORDS = 30
BROADCAST_GROUPS = 20_000
DIM = len(FLOORS)
AXES = [f"x{i}" for i in range(DIM)]
MOMENTS = [(i, j) for i in range(DIM) for j in range(i + 1)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the same text."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def among(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, k: F.when((k >= 0) & (k < n), F.get(s, k)["h"] == x["h"]).otherwise(False)
            starts = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

            def length(p: Column) -> Column:
                steps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
                return F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)

            return _let(starts, length)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ordered, among))

    def of(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        return F.when(F.size(w) < WINDOW, 0).otherwise(_let(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), window), covered))

    return _let(words, of)


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and of each whole text the base statistics, n_lines and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(SPACE_CHARS)) != "")
    words = words_of(F.col("text"))
    rows = docs.select(
        *keep,
        _let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_l"),
    )
    n, repeated = F.col("_w.n_words").cast("long"), F.col("_w.n_repeat_words").cast("long")
    return rows.select(
        *keep, n.alias("n_words"), "word_chars", "n_symbols", F.col("_l.dup").cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        F.col("_l.n").cast("long").alias("n_lines"), ((n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
    )


def chi2_cdf(x: float, dim: int) -> float:
    """For an even number of dimensions."""
    return 1 - math.exp(-x / 2) * math.fsum((x / 2) ** k / math.factorial(k) for k in range(dim // 2))


def chi2_quantile(p: float, dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dim) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """By what the covariance of the nearest ``share`` of normal rows falls short."""
    return share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


def _triangle(estimate: DataFrame) -> DataFrame:
    """Add l_ij, the Cholesky factor of the covariance with the floors added, and log_det."""
    out = estimate
    for i, j in MOMENTS:
        rest = F.col(f"c{i}{j}") + (F.lit(float(FLOORS[i] ** 2)) if i == j else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("log_det", sum((F.log(f"l{i}{i}") for i in range(DIM)), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance of the x to the centre m, by forward substitution."""
    solved: list[Column] = []
    for i in range(DIM):
        rest = F.col(AXES[i]) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * solved[k]
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    """Centre, covariance and number of rows of each group; sums are whole numbers and so exact."""
    x = {a: F.col(a).cast("decimal(19,0)") for a in AXES}
    sums = rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(x[a]).alias(f"s_{a}") for a in AXES],
        *[F.sum((F.col(AXES[i]) * F.col(AXES[j])).cast("decimal(19,0)")).alias(f"s_{i}{j}") for i, j in MOMENTS],
    )
    mean = {i: F.col(f"s_{AXES[i]}").cast("double") / F.col("_n") for i in range(DIM)}
    return _triangle(
        sums.select(
            "g", "_n", *[mean[i].alias(f"m{i}") for i in range(DIM)],
            *[(F.col(f"s_{i}{j}").cast("double") / F.col("_n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in MOMENTS],
        )
    )


def _attach(rows: DataFrame, estimates: DataFrame, total: int) -> DataFrame:
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates.drop("_n")), "g")
    return lookup(rows, estimates, "g", total, how="inner")


def groups(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, g, mean_chars) for each language and source of ``rows``, null included."""
    key = lambda *parts: F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts])
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("word_chars").alias("chars"), F.sum("n_words").alias("words"))
    small = F.col("n") < least
    sizes = sizes.withColumn("g", F.when(small, key(F.col("lang"))).otherwise(key(F.col("lang"), F.col("source"))))
    pooled = sizes.where(small).groupBy(F.col("g").alias("pool")).agg(F.sum("n").alias("pool_n"))
    sizes = sizes.join(pooled, (sizes.g == pooled.pool) & small, "left")
    sizes = sizes.withColumn("g", F.when(F.col("pool_n") < least, "").otherwise(F.col("g")))
    whole = sizes.groupBy("g").agg((F.sum("chars") / F.greatest(F.sum("words"), F.lit(1))).alias("mean_chars"), F.sum("n").alias("_n"))
    return sizes.select("lang", "source", "g").join(whole, "g")


def vectors(stats: DataFrame, total: int, least: int = LEAST) -> DataFrame:
    """The columns of ``stats``, the group g and the statistic vector x of each document that passes the base rules."""
    fit = stats.where("not base_failed")
    place = written(groups(fit, least), "quality-groups")
    pair = lambda: F.xxhash64(F.struct(F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))))
    rows = fit.withColumn("pair", pair())
    place = place.withColumn("pair", pair()).drop("lang", "source")
    if place.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(place.drop("_n")), "pair")
    else:
        rows = lookup(rows, place, "pair", total, how="inner")
    n = F.col("n_words")
    milli = lambda x: F.round(x * 1000).cast("long")
    x = [
        milli(F.log((F.col("word_chars") + PRIOR_WORDS * F.col("mean_chars")) / (n + PRIOR_WORDS))),
        milli(F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))),
        milli(F.col("n_dup_lines") / (F.col("n_lines") + 10)),
        milli(F.col("n_repeat_words") / n),
    ]
    return rows.select(*stats.columns, "g", *[c.alias(a) for c, a in zip(x, AXES)])


def estimates(rows: DataFrame, total: int, share: float = KEEP_SHARE, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group: g, _n, m, l (scaled by :func:`consistency`)."""
    middle = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile(a, F.lit(0.5)).alias(f"m{i}") for i, a in enumerate(AXES)]), "quality-medians")
    away = _attach(rows, middle, total)
    spread = away.groupBy("g").agg(
        F.first("m0").alias("_"), F.count(F.lit(1)).alias("_n"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIM)],
        *[F.percentile(F.abs(F.col(a) - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i, a in enumerate(AXES)],
    )
    start = _triangle(
        spread.select(
            "g", "_n", *[f"m{i}" for i in range(DIM)],
            *[(F.pow(1.4826 * F.col(f"d{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in MOMENTS],
        )
    )
    found = []
    for at, now in enumerate((start, _moments(rows))):
        for step in range(steps):
            now = written(now, f"quality-estimate{at}{step}")
            near = _attach(rows, now, total).select("g", *AXES, F.floor(64 * F.log2(_distance() + 2.0**-20)).cast("int").alias("bin"))
            cut = written(near.groupBy("g").agg(F.count(F.lit(1)).alias("_n"), F.percentile("bin", F.lit(share)).alias("cut")), f"quality-cut{at}{step}")
            now = _moments(_attach(near, cut, total).where("bin <= cut"))
        found.append(now.withColumn("start", F.lit(at)))
    both = written(found[0].unionByName(found[1]), "quality-starts")
    names = [c for c in both.columns if c[0] in "ml" and c[1:].isdigit()]
    best = both.groupBy("g").agg(F.min_by(F.struct(*names, F.col("_n").alias("n")), F.struct("log_det", "start")).alias("e"))
    scale = math.sqrt(consistency(share))
    return written(
        best.select("g", F.col("e.n").alias("_n"), *[(F.col(f"e.{c}") * (scale if c[0] == "l" else 1.0)).alias(c) for c in names]), "quality-estimates"
    )


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, tail: float = TAIL) -> DataFrame:
    """The columns ``keep``, the base statistics, base_failed, distance2 (null if base_failed) and kept."""
    names = tuple(dict.fromkeys([*keep, "lang", "source"]))
    stats = written(statistics(docs, names), "quality-statistics")
    total = stats.count()
    rows = vectors(stats, total, least)
    measured = _attach(rows, estimates(rows, total), total).select(*stats.columns, _distance().alias("distance2"))
    failed = stats.where("base_failed").withColumn("distance2", F.lit(None).cast("double"))
    return measured.unionByName(failed).select(
        *keep, *BASE, "base_failed", "distance2", (~F.col("base_failed") & (F.col("distance2") <= chi2_quantile(1 - tail, DIM))).alias("kept")
    )


def filtered(docs: DataFrame, least: int = LEAST, tail: float = TAIL) -> DataFrame:
    """The documents that are kept, with their own columns; needs no unique ids."""
    own = [f"_own_{c}" for c in docs.columns]
    return (
        judged(docs.select(*[F.col(c).alias(o) for c, o in zip(docs.columns, own)], "text", "lang", "source"), tuple(own), least, tail)
        .where("kept").select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own)])
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of every whole text of ``documents``."""
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2"))
