"""From a corpus to training blocks, and from two vocabularies to frozen rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.words import required
from corpusweave.operators.encode import Codec, encode, texts, token_count
from corpusweave.operators.matrix import zero_rows
from corpusweave.operators.order import natural_order, positions, run_starts
from corpusweave.operators.pack import (
    number_blocks,
    pack_batches,
    pack_global,
    packing_accounts,
    packing_groups,
    truncate_documents,
)
from corpusweave.operators.permute import permute_splits
from corpusweave.operators.splits import Cuts, assign_splits, holdout_cuts, limit_positions
from corpusweave.operators.vocab import freeze_ids
from corpusweave.params import PrepareParams, Specials
from corpusweave.session import settled
from corpusweave.sources.parquet import read_corpus

ORDER = ["order_key", "order_bucket"]
PLACE = ["pos", "split_rows"]
COUNTED = ["doc_id", "split", *ORDER, *PLACE]


def kept_documents(corpus: DataFrame, params: PrepareParams, cuts: Cuts | None = None) -> DataFrame:
    """The documents that a run keeps, each with its split and order.

    Splitting and limiting come before encoding, so that only kept texts are encoded.
    Rows that were read with their file positions keep them where nothing is held
    out; ``pos`` is then known without any shuffle.
    """
    rows = texts(corpus, params.text_column, params.on_null)
    if params.shuffle == "permuted":
        if params.on_null == "drop" or not set(PLACE) <= set(corpus.columns):
            rows = positions(natural_order(rows.drop(*PLACE))).drop(*ORDER)
        return natural_order(permute_splits(rows, params), "pos")
    if places_known(corpus, params):
        return natural_order(limit_positions(rows, params.n_train, params.n_val, params.n_test))
    return assign_splits(rows, params, cuts)


def places_known(corpus: DataFrame, params: PrepareParams) -> bool:
    """Whether kept documents have their places without counting runs: by the files, or by a permutation of these."""
    held_out = bool(params.n_val or params.n_test)
    return params.shuffle == "permuted" or (not held_out and params.on_null == "fail" and set(PLACE) <= set(corpus.columns))


def kept_and_counted(corpus: DataFrame, params: PrepareParams) -> tuple[DataFrame, DataFrame]:
    """``kept_documents``, and their ``token_counts`` stored, as run totals and packing groups both come from these.

    Without a limit all texts are counted, and the cut-offs of a holdout are found in the stored rows too; with one, only the texts
    that it keeps are counted.
    """
    if params.n_train:
        kept = kept_documents(corpus, params)
        return kept, settled(token_counts(kept))
    text = F.col(params.text_column).cast("string")
    rows = corpus.where(text.isNotNull()) if params.on_null == "drop" else corpus
    split = required(F.col("split"), "split").alias("split")
    sizes = settled(token_counts(rows.select("doc_id", split, text.alias("text"))))
    n_val, n_test = params.n_val or 0, params.n_test or 0
    cuts = holdout_cuts(sizes, n_val, n_test, params.seed) if n_val + n_test else None
    # A null text is an error in a document that is kept, not in one of a split that a holdout replaces.
    counted = assign_splits(sizes, params, cuts).withColumn("n_tokens", required(F.col("n_tokens"), params.text_column))
    return kept_documents(corpus, params, cuts), counted


def token_counts(kept: DataFrame) -> DataFrame:
    """Sizes of the documents, counted from their texts alone; null where the text is."""
    known = [c for c in (*ORDER, *PLACE) if c in kept.columns]
    n_tokens = F.when(F.col("text").isNotNull(), token_count(F.col("text"))).cast("long")
    return kept.select("doc_id", "split", *known, n_tokens.alias("n_tokens"))


def with_positions(docs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return docs if set(PLACE) <= set(docs.columns) else positions(docs, starts=starts)


def prepare_corpus(
    corpus: DataFrame,
    vocab: DataFrame | None,
    specials: Specials,
    params: PrepareParams,
    codec: Codec | None = None,
) -> DataFrame:
    """Split, limit, encode, then pack into blocks or truncate.

    ``corpus`` has ``doc_id``, ``split`` and the text column. The result has ``split``,
    ``pos``, the place of the row in its split, ``input_ids`` and ``attention_mask``. Texts are
    encoded by the vocabulary, or by a codec of the caller's.
    """
    if params.use_packing and params.grouping == "batches" and codec is None and not places_known(corpus, params):
        kept, counted = kept_and_counted(corpus, params)
    else:
        kept, counted = kept_documents(corpus, params), None
    known = [c for c in PLACE if c in kept.columns]
    docs = encode(kept, vocab, specials, ["doc_id", "split", *ORDER, *known], codec, params.encoding)
    if not params.use_packing:
        cut = truncate_documents(docs, params.max_seq_length)
        return with_positions(cut).select("split", "pos", "doc_id", "input_ids", "attention_mask")
    if codec is not None:  # its ids are needed twice, for totals and for blocks
        docs = settled(docs)
        counted = docs.select(*[c for c in docs.columns if c in COUNTED], F.size("input_ids").cast("long").alias("n_tokens"))
    elif counted is None:
        counted = token_counts(kept)
    if params.grouping == "global":
        return pack_global(docs, specials, params.max_seq_length, counted).withColumn("pos", F.col("block"))
    starts = None if set(PLACE) <= set(docs.columns) else run_starts(counted)  # for ids and for counts
    placed = with_positions(docs, starts)
    blocks = pack_batches(placed, specials, params.max_seq_length, params.shards, params.batch_rows)
    groups = packing_groups(with_positions(counted, starts), params.shards, params.batch_rows)
    return number_blocks(blocks, groups, params.max_seq_length)


def prepare_path(
    spark: SparkSession,
    path: str,
    vocab: DataFrame | None,
    specials: Specials,
    params: PrepareParams,
    codec: Codec | None = None,
    spread_over: int | None = None,
) -> DataFrame:
    """``prepare_corpus`` of a parquet file or of a directory of splits."""
    corpus = read_corpus(spark, path, params.text_column, spread_over)
    return prepare_corpus(corpus, vocab, specials, replace(params, text_column="text"), codec)


def corpus_accounts(corpus: DataFrame, params: PrepareParams) -> DataFrame:
    """Blocks, tokens in and tokens dropped per split, found without encoding.

    Counts words, so it speaks for runs against a vocabulary, not for those of a codec.
    """
    sizes = token_counts(kept_documents(corpus, params))
    if params.grouping == "global":
        groups = sizes.withColumn("shard", F.lit(0)).withColumn("batch", F.lit(0))
    else:
        groups = packing_groups(with_positions(sizes), params.shards, params.batch_rows)
    return packing_accounts(groups, params.max_seq_length)


def freeze_matrix(first: DataFrame, second: DataFrame, matrix: DataFrame) -> DataFrame:
    """The matrix with the rows of tokens that both vocabularies share set to zero."""
    return zero_rows(matrix, freeze_ids(first, second, matrix))


def split_views(prepared: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """One view per split, for callers who want them apart."""
    return {name: prepared.where(F.col("split") == name) for name in names}
