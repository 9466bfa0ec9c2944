"""From raw documents to token files: five stages, each reading what the one before it wrote.

1. ``quality`` drops documents that the quality model, learned from the labels outside the held-out
   third, scores below one half.
2. ``near_duplicates`` keeps one document of every class of near copies.
3. ``decontaminate`` drops documents that contain a benchmark item.
4. ``mix`` repeats documents until the sources stand at their target weights: every document stays once
   at least and none comes more than twice; the document at which a source reaches its target comes
   again with its first words only.
5. ``tokens`` writes the ids of the mixture as ORC files and returns what the files hold.

An empty table passes through every stage; documents without words leave at the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depotlens.llm import decontamination, mixing, near_dedup, quality_classifier, token_output
from depotlens.llm.queries import public_vocabulary, table
from depotlens.session import share_package, written_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    measured = quality_classifier.measured_documents(docs)
    model = quality_classifier.learn(measured, labels.filter(~quality_classifier.in_fold(labels["doc_id"])))
    return quality_classifier.keep_good(docs, model) if model else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(docs, near_dedup.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken, _ = mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, cap=2.0, floor=1.0)
    return mixing.mixed_documents(docs, taken)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = token_output.scratch_path(spark, "pipeline-tokens")
    token_output.write_token_files(docs, path, public_vocabulary(), end_id=2)
    return token_output.token_digest(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: A trained model and near-duplicate classes are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    share_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
