"""Corpus preparation for language models as Spark DataFrame operators."""

from corpusweave.params import DEFAULT, SMOKE, PrepareParams, Specials
from corpusweave.plans.prepare import corpus_accounts, freeze_matrix, prepare_corpus, prepare_path, split_views
from corpusweave.sources.parquet import read_corpus

__all__ = [
    "DEFAULT",
    "SMOKE",
    "PrepareParams",
    "Specials",
    "corpus_accounts",
    "freeze_matrix",
    "prepare_corpus",
    "prepare_path",
    "read_corpus",
    "split_views",
]
