"""From raw documents to token ids.

Every stage takes all that its predecessor kept: documents in a language, their recurring lines dropped, one of each group of
near-duplicates, mixed to target weights, encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, jaccard, language, mixing, templates
from strandloom.llm.common import table, written


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose trigrams are likelier under the languages found in them than by chance."""
    return language.identify(docs, language.fit(docs)).where(language.accepted()).select(*docs.columns)


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; n_chars follows."""
    kept = templates.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity 0.8."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, which decode to its text."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), check=True)
    return ids.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("language", in_a_language),
    ("lines", without_templates),
    ("copies", without_copies),
    ("mix", mixed),
    ("tokens", encoded),
]
#: SQL can express neither the language model nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
