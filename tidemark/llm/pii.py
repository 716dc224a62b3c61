"""Personal data by weak supervision, in DataFrame functions only.

Fixed-form matches (e-mail, IP, card, phone) are always reported. Further candidates are fixed-form
matches that fail their check and looser forms (local phone numbers, social security numbers, IBANs,
names after a title). Three labelers vote on every candidate (1 yes, -1 no, 0 don't know): *regex*
(does it pass the strict form), *gazetteer* (domains and names that the corpus itself has in RECURS
documents or more; numbering rules of countries and issuers) and *context* (cue words before it).
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each
kind's share of true spans; its posteriors are the soft labels of a naive Bayes span classifier over
bucketed span features, and that classifier alone decides which candidates are added.

What reaches the driver is one count per kind and vote pattern (at most 8 * 27 rows) and one sum per
kind, feature and bucket (a few hundred rows), whatever the size of the corpus. Domains and names that
recur are counted and joined back by Spark.

Defined cases: a null text is empty and has no spans; texts are scanned whole and patterns have no
unbounded repeated groups, so long runs don't exhaust the stack; overlapping spans of different kinds
are all reported, added ones that overlap a fixed-form span or are nested in another are not; with no
candidates nothing is added; repeated rows give repeated results; further columns are ignored by
:func:`spans` except those that it is asked to keep.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, table, written
from tidemark.llm.quality import _let

# Each pattern finds the same matches as the plain one beside it in PLAIN; possessive and bounded
# parts keep the matcher linear and off the stack.
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@(?=[{LABEL}]++\.[{LABEL}])[{LABEL}.]+?(?=\.\.|\.?(?![{LABEL}.]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "phone": "+"}
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra"
LOOSE = {
    "ssn": r"(?<![0-9A-Za-z+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+)-])(?<![0-9)][\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<![A-Za-z])(?:{TITLES})\.?\x20[A-Z][a-z]{{1,20}}(?:\x20[A-Z][a-z]{{1,20}})?",
}
KINDS = [*PATTERNS, *LOOSE]

# Numbering rules and cue words.
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
COUNTRY_CODES = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
RESERVED = r"^(?:0|10|127|192\.168|169\.254|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
IBAN_COUNTRIES = "^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)"
CUES = {
    "email": "e-?mail|contact|write to|kontakt|courriel|correo",
    "ip": r"\bip\b|address|host|server|client|adresse",
    "card": r"\bcard|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|fax|anruf|appel|llam",
    "ssn": r"\bssn\b|social security",
    "local_phone": r"phone|\btel|call|mobile|fax|anruf|appel|llam",
    "iban": r"\biban\b|account|konto|compte|cuenta",
    "name": r"contact|dear|signed|name|from|kontakt|nom\b|nombre",
}
ANTI = r"order|invoice|version|isbn|\bsku\b|serial|ticket|tracking|rechnung|facture|pedido|\bno\.$"
CONTEXT = 40
LABELERS = ("regex", "gazetteer", "context")
ROUNDS, SMOOTHING, ADD_AT = 60, 1.0, 0.8
#: First assumed reliability of the labelers, and its weight against the votes.
RELIABLE, ANCHOR = 0.9, 0.25
#: A domain or name in so many documents or more is known.
RECURS = 3
#: So many rows with known domains or names (about 100 bytes each) are broadcast at most.
BROADCAST_ROWS = 200_000


def matches(text: Column, kind: str) -> Column:
    """(kind, start, end, value) of every match; offsets in code points."""
    pattern = {**PATTERNS, **LOOSE}[kind]

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda p: F.char_length(p))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            end = at + F.char_length(x["value"])
            span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        both = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.aggregate(both, start, add, lambda acc: acc["out"])

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike("[0-9]") if kind != "name" else F.lit(True)
    return F.when(hint, found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        def weigh(i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            doubled = F.when(i % 2 == 0, 2 * x).otherwise(x)
            return doubled - F.when(doubled > 9, 9).otherwise(0)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), weigh), F.lit(0), lambda a, x: a + x)

    return _let(F.reverse(_digits(value)), total) % 10 == 0


BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def passes(kind: str, value: Column) -> Column:
    """The check that a fixed-form match must pass."""
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _key(kind: Column, value: Column) -> Column:
    """What is looked up among the corpus' own domains and names; null for other kinds."""
    domain, name = F.lower(F.substring_index(value, "@", -1)), F.regexp_extract(value, r"\x20([A-Z][a-z]+)", 1)
    return F.when(kind == "email", F.concat(F.lit("email "), domain)).when(kind == "name", F.concat(F.lit("name "), name))


def mod97(value: Column) -> Column:
    """An IBAN as a number modulo 97, which is 1 for a valid one."""
    bare = F.replace(value, F.lit(" "))
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add)


def _rules(kind: Column, value: Column) -> Column:
    """The gazetteer's vote on numbers, by the rules of those who issue them: they refute, only a check sum confirms."""
    good = {
        "ip": ~value.rlike(RESERVED), "card": _digits(value).rlike(ISSUERS), "phone": value.rlike(COUNTRY_CODES),
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"), "local_phone": value.rlike(r"^\(?[2-9]"), "iban": value.rlike(IBAN_COUNTRIES) & (mod97(value) == 1),
    }
    return reduce(lambda rest, k: F.when(kind == k, F.when(good[k], int(k == "iban")).otherwise(-1)).otherwise(rest), good, F.lit(0))


def _context(kind: Column, before: Column) -> Column:
    cue = reduce(lambda rest, k: F.when(kind == k, before.rlike(CUES[k])).otherwise(rest), CUES, F.lit(False))
    return F.when(cue, 1).when(before.rlike(ANTI), -1).otherwise(0)


def candidates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, base (fixed-form spans that pass) and loose (other candidates with votes and features)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), *[matches(text, k).alias(f"_{k}") for k in KINDS])
    kept = lambda kind, good: F.filter(f"_{kind}", lambda s: passes(kind, s["value"]) == good)
    split = rows.select(
        *keep, "_text",
        F.concat(*[kept(k, True) for k in PATTERNS]).alias("_base"),
        F.concat(*[kept(k, False) for k in PATTERNS if k != "email"], *[F.col(f"_{k}") for k in LOOSE]).alias("_other"),
    )
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    wider = lambda a, b: overlaps(a, b) & (a["end"] - a["start"] < b["end"] - b["start"])
    split = split.withColumn(
        "_other",
        F.when(F.size("_other") == 0, F.col("_other")).otherwise(
            F.filter("_other", lambda s: ~F.exists("_base", lambda b: overlaps(s, b)) & ~F.exists("_other", lambda b: wider(s, b)))
        ),
    )

    def judged(strict: bool):
        def of(s: Column) -> Column:
            start = F.greatest(s["start"] - CONTEXT, F.lit(0))
            before = F.lower(F.substring(F.col("_text"), start + 1, s["start"] - start))
            regex = F.lit(1) if strict else F.when(s["kind"].isin(*PATTERNS), -1).otherwise(0)
            n = F.length(s["value"])
            return F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                regex.alias("regex"), _rules(s["kind"], s["value"]).alias("gazetteer"), _context(s["kind"], before).alias("context"),
                F.least(F.floor(n / 4), F.lit(12)).cast("int").alias("size"),
                F.floor(4 * F.length(_digits(s["value"])) / n).cast("int").alias("digits"),
                s["value"].rlike(r"[\x20()-]").cast("int").alias("separated"),
                F.when(before.rlike(r"[:=]\x20*$"), 1).otherwise(0).alias("after_colon"), _key(s["kind"], s["value"]).alias("key"),
            )

        return of

    return split.select(*keep, F.transform("_base", judged(True)).alias("base"), F.transform("_other", judged(False)).alias("loose"))


def voted(found: DataFrame) -> DataFrame:
    """Candidates numbered by ``_row``, with the gazetteer's votes on domains and names that recur in the corpus.

    A key of very many documents is joined by broadcast and no key's rows meet in one task, see ``lookup``.
    """
    has_key = F.exists(F.concat("base", "loose"), lambda s: s["key"].isNotNull())
    each = found.where(has_key).select("_row", F.explode(F.array_distinct(F.filter(F.transform(F.concat("base", "loose"), lambda s: s["key"]), lambda k: k.isNotNull()))).alias("key"))
    each = written(each, "pii-keys")
    recurring = each.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= RECURS)
    known = written(lookup(each, recurring, "key", each.count(), how="inner").groupBy("_row").agg(F.collect_set("key").alias("_known")), "pii-known")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    vote = lambda s: s.withField("gazetteer", F.when(s["key"].isNull(), s["gazetteer"]).when(F.array_contains("_known", s["key"]), 1).otherwise(0))
    told = lambda c: F.when(F.col("_known").isNull(), F.col(c)).otherwise(F.transform(c, vote)).alias(c)
    return found.join(known, "_row", "left").select(*[c for c in found.columns if c not in ("base", "loose")], told("base"), told("loose"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a candidate is true, by kind and vote pattern, from the patterns' counts.

    Expectation-maximisation of a model in which labelers vote independently given the truth, each right
    with a reliability of its own; that it doesn't vote says nothing. The first assumptions, that labelers
    are right (RELIABLE) and that half of a kind's candidates are true, keep the weight of ANCHOR times a
    labeler's votes and of all the kind's candidates, for the votes alone can't tell a kind with few true
    spans from unreliable labelers.
    """
    sure = [RELIABLE] * len(LABELERS)
    counts = {kind: sum(n for k, _, n in patterns if k == kind) for kind, _, _ in patterns}
    prior = dict.fromkeys(counts, 0.5)
    post: dict = {}
    for _ in range(rounds):
        for kind, vote, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + math.fsum(v * math.log(a / (1 - a)) for v, a in zip(vote, sure))
            post[kind, vote] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        for kind, n in counts.items():
            prior[kind] = (math.fsum(post[k, v] * m for k, v, m in patterns if k == kind) + n / 2 + SMOOTHING) / (2 * n + 2 * SMOOTHING)
        for i in range(len(LABELERS)):
            n = sum(m for _, v, m in patterns if v[i])
            right = math.fsum(m * (post[k, v] if v[i] == 1 else 1 - post[k, v]) for k, v, m in patterns if v[i])
            sure[i] = (right + RELIABLE * (ANCHOR * n + 2 * SMOOTHING)) / (n + ANCHOR * n + 2 * SMOOTHING)
    return post


FEATURES = (*LABELERS, "size", "digits", "separated", "after_colon")


def train(found: DataFrame) -> dict[str, tuple[float, dict[tuple[str, int], float]]]:
    """Per kind, the log odds and the weight of each (feature, bucket) of the span classifier."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*")
    # bounded: one row for each kind and vote pattern
    patterns = [(r[0], tuple(r[1:4]), r[4]) for r in each.groupBy("kind", *LABELERS).count().orderBy("kind", *LABELERS).collect()]
    if not patterns:
        return {}
    post = estimate(patterns)
    key = F.concat_ws("|", "kind", *LABELERS)
    label = F.element_at(F.create_map(*[F.lit(x) for (k, v), p in post.items() for x in ("|".join([k, *map(str, v)]), p)]), key)
    buckets = each.groupBy("kind", *FEATURES).count().withColumn("p", label)
    long = buckets.select("kind", "p", "count", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bucket")) for f in FEATURES])).alias("x"))
    # bounded: one row for each kind, feature and bucket
    sums = long.groupBy("kind", "x.feature", "x.bucket").agg(F.sum(F.col("p") * F.col("count")).alias("yes"), F.sum("count").alias("n")).collect()
    model = {}
    for kind in {k for k, _, _ in patterns}:
        total = {1: math.fsum(post[k, v] * n for k, v, n in patterns if k == kind), 0: math.fsum((1 - post[k, v]) * n for k, v, n in patterns if k == kind)}
        own = [r for r in sums if r["kind"] == kind]
        wide = {f: sum(r["feature"] == f for r in own) + 1 for f in FEATURES}
        rate = lambda x, f, y: math.log((x + SMOOTHING) / (total[y] + SMOOTHING * wide[f]))
        model[kind] = (
            math.log((total[1] + SMOOTHING) / (total[0] + SMOOTHING)),
            {(r["feature"], r["bucket"]): rate(r["yes"], r["feature"], 1) - rate(max(0.0, r["n"] - r["yes"]), r["feature"], 0) for r in own},
        )
    return model


def spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), add_at: float = ADD_AT) -> DataFrame:
    """The columns ``keep``, and base_spans and added_spans: arrays of (kind, start, end) in order of start.

    A candidate that fails a fixed form, or has a loose one, is added where the classifier gives it a
    probability of ``add_at`` or more.
    """
    # numbered and written once, so that all that follows sees the same numbers
    found = voted(written(candidates(docs, keep).withColumn("_row", F.monotonically_increasing_id()), "pii-candidates"))
    model = train(found)
    flat = [(f"{k}|{f}|{b}", w) for k, (_, weights) in model.items() for (f, b), w in weights.items()] or [("", 0.0)]
    weights = F.create_map(*[F.lit(x) for pair in flat for x in pair])
    odds = F.create_map(*[F.lit(x) for pair in [(k, o) for k, (o, _) in model.items()] or [("", 0.0)] for x in pair])

    def score(s: Column) -> Column:
        terms = [F.coalesce(weights[F.concat_ws("|", s["kind"], F.lit(f), s[f])], F.lit(0.0)) for f in FEATURES]
        return sum(terms, F.coalesce(odds[s["kind"]], F.lit(0.0)))

    added = F.filter("loose", lambda s: score(s) >= math.log(add_at / (1 - add_at)))
    slim = lambda x: F.transform(ordered(x), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return found.select(
        *keep, F.when(F.size("base") == 0, empty).otherwise(slim(F.col("base"))).alias("base_spans"),
        F.when(F.size("loose") == 0, empty).otherwise(slim(added)).alias("added_spans"),
    )


def ordered(found: Column) -> Column:
    """Spans by start and then kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    rows = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("o"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.sort_array(rows)


def listed(found: Column) -> Column:
    return F.when(F.size(found) == 0, "").otherwise(F.array_join(F.transform(ordered(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span (or run of overlapping ones) replaced by its first kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(ordered(found), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with the spans of their texts replaced; n_chars, where there is one, follows the text."""
    own = [f"_own_{c}" for c in docs.columns]
    rows = spans(docs.select(*[F.col(c).alias(o) for c, o in zip(docs.columns, own)], "text"), tuple(own))
    text = redacted(F.col("_own_text"), F.concat("base_spans", "added_spans"))
    changed = F.size("base_spans") + F.size("added_spans") > 0
    out = {c: F.col(o).alias(c) for c, o in zip(docs.columns, own)}
    if "n_chars" in out:
        rows = rows.withColumn("_text", text)
        out["n_chars"] = F.when(changed, F.char_length("_text")).otherwise(F.col("_own_n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        text = F.col("_text")
    out["text"] = text.alias("text")
    return rows.select(*out.values())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    rows = spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(k) for k in PATTERNS], F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.concat("base_spans", "added_spans")).alias("spans"), F.size("added_spans").cast("long").alias("n_added"),
    )


def brute_force(text: str | None) -> str:
    """kind:start:end of the fixed-form spans of one text, straight from the plain patterns; for tests."""
    text, found = text or "", []
    for at, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                good = 14 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
            else:
                good = kind == "email" or 10 <= len(digits) <= 15
            if good:
                found.append((m.start(), at, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
