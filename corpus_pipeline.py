"""A training-data pipeline over ``documents``, as a chain of stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as Parquet and
read again as the next one's ``docs``; all but the last keep the columns of ``documents``, and any others
that are there.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusweave.llm import bpe, mixing, pii, simhash, toxicity
from corpusweave.llm.common import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not predict toxic."""
    model = toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    names = docs.columns
    plain = docs.toDF(*[f"column{i}" for i in range(len(names))])  # no name clashes with those of the scores
    text = plain.columns[names.index("text")]
    kept = toxicity.score_toxicity(plain, model, tuple(plain.columns), text).where("predicted = 0")
    return kept.select(*plain.columns).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and without the terms that disclose it."""
    return pii.sanitised(docs, max_alike=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: one row per pass of a document, a text in service at the end cut off there."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text they decode to."""
    model = bpe.load(spark, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode_bpe(docs, model, decoded="decoded")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix),
    ("bpe", encode),
]

# The stages hold trained models and tokenizers, which SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
