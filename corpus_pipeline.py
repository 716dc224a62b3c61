"""The documents of a corpus, cleaned and encoded in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``. :func:`run` writes each stage's result to the shared folder and
reads it back, so a lost executor costs at most one stage.

Defined cases for every stage: an empty table gives no rows; rows with null ids, languages or sources are
documents like others (null languages and sources are a group); further columns pass through all but the
last stage, whatever their names; texts are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, pii, quality, simhash
from tidemark.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do null, empty and blank texts, which have no words."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays, of equal texts and ids one row.

    Links are between sets of five-word shingles of a similarity of 0.8 or more. Operator 4's trie join finds
    them by wider fingerprints than its query's, and each is confirmed on the full sets.
    """
    return simhash.similar_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go; with no items all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; n_chars follows, a null text stays null."""
    return pii.without_personal_data(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their round trip; a null text has no ids."""
    return bpe.round_trip(docs, *bpe.public_ranks())


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("byte bpe", byte_bpe),
]

#: Robust estimates, trie joins and merges aren't expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{at + 1}")
    return docs
