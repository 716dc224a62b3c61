import hashlib

import corpus_pipeline
from tidemark.llm import decontaminate, pii, quality


def five_words(text):
    words = text.encode().lower().split()
    return {tuple(words)} if len(words) < 5 else set(zip(*(words[k:] for k in range(5))))


def test_stages_match_a_plain_version(spark, sf_small, docs, texts):
    items = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()])
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    sets = {i: five_words(texts[i]) for i in kept}
    like = {i: [j for j in kept if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in kept}
    group = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for i in kept:
            least = min(group[j] for j in like[i])
            changed |= least != group[i]
            group[i] = least
    want = {}
    for i in set(group.values()):
        if not items.search(texts[i]):
            text, out, at = texts[i], "", 0
            for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in pii.brute_force(text).split(",") if s)), key=lambda s: (s[1], pii.KINDS.index(s[0]))):
                if a >= at:
                    out += text[at:a] + f"[{kind.upper()}]"
                at = max(at, b)
            want[i] = hashlib.sha256((out + text[at:]).encode()).hexdigest()
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf_small).collect()}
    assert got == want


def test_stages_return_the_columns_of_documents(spark, sf_small, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_small).columns == docs.columns


def test_odd_rows_and_empty_tables(spark, tmp_path, docs, sf_small):
    """Nulls in every column, repeated rows and ids, texts that are blank or very long, and no documents at all."""
    good = docs.where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").limit(40)
    text = good.orderBy("doc_id").first().text
    unlike = " ".join(f"{w}{i % 7}" for i, w in enumerate(text.split()))
    rows = [(None, unlike, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, " \n\t ", "en", None, 3), (9004, "x" * 100_000, "en", "s", 100_000)]
    rows += [(9005, text, "en", "s", len(text)), (9005, text, "en", "s", len(text))]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    both = good.select(*odd.columns).unionByName(odd)
    both.repartition(3).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.read.parquet(f"{sf_small}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()]
    assert len(got) == len(set(got)) and not {9001, 9002, 9003, 9004} & set(got)
    assert set(got) <= {r.doc_id for r in both.collect()} and len(got) > 20
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
