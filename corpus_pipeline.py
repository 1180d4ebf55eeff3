"""A training-data pipeline over ``documents``: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import exact_dedup, jaccard, language, mixing, pieces
from tallymark.llm.common import materialize
from tallymark.llm.queries import ANCHOR, WEIGHTS, domains, piece_model, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without letters or without a clear language go."""
    return language.keep_identified(docs, language.train(docs.where(~language.held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles stays, that of the smallest doc_id."""
    return jaccard.keep_one_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the fitted mixture takes it."""
    return mixing.apply_mix(docs, domains(table(spark, sf_dir, "labels")), WEIGHTS, ANCHOR)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text, one row per row of the mixture."""
    return pieces.encode_documents(docs, piece_model())


STAGES = [("language ID", language_id), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing to target weights", mixture), ("SentencePiece encoding", encoding)]

#: Trained models and a seeded mixture are beyond SQL: the tests compare with brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
