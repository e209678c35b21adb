"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next one
works on all of it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, language_id, packing, pii
from tessera.llm.common import Scratch, table


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns whose names an operator's results take moved aside, and the names to give them back."""
    names = {c: f"own_{i}_{c}" if c in taken else c for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (those without a letter) go; the others get the predicted language.

    Prototypes are learned from the given languages, without the held-out quarter. Where no language is given nothing
    can be learned, and all documents stay as they are.
    """
    prototypes = language_id.train(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
    if not prototypes:
        return docs
    own, names = _aside(docs, ("lang_pred", "score"))
    found = language_id.predict(own, prototypes, keep=tuple(own.columns))
    found = found.filter(F.col("lang_pred") != language_id.UNDETERMINED).withColumn("lang", F.col("lang_pred"))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 of their five-word shingles stays: the smallest doc_id."""
    return jaccard_join.one_of_each(docs, jaccard_join.Rule(5, 80, 100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    own, names = _aside(docs, ("base", "spans", "redacted"))
    found = pii.find_pii(own, pii.train_field(docs), keep=tuple(own.columns)).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*(F.col(n).alias(c) for c, n in names.items()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_identification", language_identification),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Hyperdimensional profiles, the trained field and the tokenizer are beyond SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
