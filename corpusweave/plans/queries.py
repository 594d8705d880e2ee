"""The registered queries: every operator on the given tables.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables. Id lists
are shown as comma-joined text and doubles rounded to six places, so that results
compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.integers import int_div
from corpusweave.operators import vocab as V
from corpusweave.operators.batched import map_batches, map_groups
from corpusweave.operators.bitmaps import both, either, id_bitmaps, id_count, ids_of, with_membership, zero_rows_by_bitmap
from corpusweave.operators.chat import strip_role_markers
from corpusweave.operators.collate import collate
from corpusweave.operators.encode import decode, encode, encode_prompts, texts, word_ids_by_join
from corpusweave.operators.matrix import l1_exact, l1_totals, zero_input_and_output, zero_rows
from corpusweave.operators.metrics import perplexity, perplexity_exact, sequence_losses, token_losses
from corpusweave.operators.order import head_tail, natural_order, positions, seeded_order, unique_sorted
from corpusweave.operators.pack import pack_batches, pack_global, packing_groups, truncate_documents
from corpusweave.operators.permute import permute_splits, permuted_position
from corpusweave.operators.pieces import piece_decoder, piece_encoder, piece_vocabulary
from corpusweave.operators.preview import preview
from corpusweave.operators.splits import assign_splits, split_sizes
from corpusweave.operators.streamed import pack_streamed
from corpusweave.params import IGNORE_LABEL, PrepareParams, Specials
from corpusweave.plans.prepare import corpus_accounts, freeze_matrix, prepare_corpus, prepare_path, token_counts
from corpusweave.session import settled, shared_folder
from corpusweave.sources.block_store import read_blocks, read_manifest, write_blocks
from corpusweave.sources.parquet import read_corpus, read_ids, rows_of_shard, write_ids, write_splits
from corpusweave.sources.step_store import store_steps, stored_token_losses

Query = Callable[[SparkSession, str], DataFrame]

VOCAB_SIZE = 4096
LENGTH = 128
BATCH_ROWS = 300
STEP_BUCKETS = 16
SPECIALS = V.SPECIALS

HOLDOUT = PrepareParams(max_seq_length=LENGTH, n_val=30, n_test=50, shards=4, batch_rows=100)
LIMITED = PrepareParams(max_seq_length=LENGTH, n_train=100, n_val=30, n_test=50)
FILE_ORDER = PrepareParams(max_seq_length=LENGTH, shards=12, batch_rows=30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts: dealt out, as each test table is one row group."""
    return documents(spark, sf_dir).repartition(slots(spark), "doc_id")


def spread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but a table of as many files stays where it is read."""
    docs = documents(spark, sf_dir)
    return docs if len(docs.inputFiles()) >= slots(spark) else full_texts(spark, sf_dir)


def slots(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def by_language(docs: DataFrame) -> DataFrame:
    """Documents with the language in the place of the split, in id order."""
    return natural_order(docs.withColumnRenamed("lang", "split").drop("source"))


def train_only(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.lit("train").alias("split"))


def delivered_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus delivered with splits of its own, taken from the source."""
    split = (
        F.when(F.col("source") == "src0", "validation").when(F.col("source") == "src1", "extra").otherwise("train")
    )
    return documents(spark, sf_dir).select("doc_id", "text", split.alias("split"))


def vocab_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frequency_vocabulary(full_texts(spark, sf_dir), VOCAB_SIZE)


def vocab_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frequency_vocabulary(full_texts(spark, sf_dir).where("lang <> 'de'"), VOCAB_SIZE)


def encoded_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(by_language(full_texts(spark, sf_dir)))
    return encode(docs, vocab_a(spark, sf_dir), SPECIALS, ["doc_id", "split", "order_key", "order_bucket"])


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def steps(spark: SparkSession, sf_dir: str, label: Column | None = None) -> DataFrame:
    """Embedding rows as the logits of steps, eight to a sequence."""
    return table(spark, sf_dir, "embeddings").select(
        int_div(F.col("vec_id"), 8).alias("seq_id"),
        (F.col("vec_id") % 8).alias("pos"),
        F.col("embedding").alias("logits"),
        (F.col("label") if label is None else label).alias("label"),
    )


def partly_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("label") == 0, IGNORE_LABEL).otherwise(F.col("label"))
    return steps(spark, sf_dir, label)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def step_arrays(rows: DataFrame) -> DataFrame:
    """Steps as one row per sequence, the layout that a model gives."""
    step = F.array_sort(F.collect_list(F.struct("pos", "logits", "label")))
    sequences = rows.groupBy("seq_id").agg(step.alias("steps"))
    return sequences.select("seq_id", F.col("steps.logits").alias("logits"), F.col("steps.label").alias("labels"))


def shown(rows: DataFrame, *arrays: str) -> DataFrame:
    """Id arrays as text."""
    for name in arrays:
        rows = rows.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))
    return rows


def rounded(rows: DataFrame, *names: str) -> DataFrame:
    for name in names:
        rows = rows.withColumn(name, F.round(name, 6))
    return rows


# Scans, projections, order, splits


def corpus_scan(spark, sf_dir):
    return read_corpus(spark, f"{sf_dir}/documents.parquet")


def text_projection(spark, sf_dir):
    return texts(documents(spark, sf_dir)).select("doc_id", "text")


def shard_sample(spark, sf_dir):
    """One part of a corpus of three files, the tables that have a text."""
    files = [f"{sf_dir}/{name}.parquet" for name in ("documents", "conversations", "benchmark")]
    corpus = spark.read.schema("text STRING").parquet(*files)
    return rows_of_shard(corpus, "benchmark.parquet").select("text")


def far_ids(spark, sf_dir):
    """Documents with ids all over BIGINT, negative ones among them."""
    docs = by_language(documents(spark, sf_dir)).drop("order_key", "order_bucket")
    return natural_order(docs.withColumn("doc_id", (F.col("doc_id") * 7919 % 1009 - 500) * F.lit(1 << 53) + F.col("doc_id")))


def row_positions_any_id(spark, sf_dir):
    return positions(far_ids(spark, sf_dir)).select("doc_id", "split", "pos", "split_rows")


def split_any_id(spark, sf_dir):
    rows = far_ids(spark, sf_dir).drop("order_key", "order_bucket").withColumn("split", F.lit("train"))
    return assign_splits(rows, HOLDOUT).select("doc_id", "split")


def row_positions(spark, sf_dir):
    return positions(by_language(documents(spark, sf_dir))).select("doc_id", "split", "pos", "split_rows")


def seeded_shuffle(spark, sf_dir):
    return positions(seeded_order(train_only(documents(spark, sf_dir)), 42)).select("doc_id", "pos")


def split_holdout(spark, sf_dir):
    return assign_splits(train_only(documents(spark, sf_dir)), HOLDOUT).select("doc_id", "split")


def seeded_permutation(spark, sf_dir):
    corpus = read_corpus(spark, f"{sf_dir}/documents.parquet")
    return corpus.select("doc_id", permuted_position(F.col("pos"), F.col("split_rows"), 42).alias("pos"))


def split_permuted(spark, sf_dir):
    corpus = read_corpus(spark, f"{sf_dir}/documents.parquet")
    return permute_splits(corpus, LIMITED).select("doc_id", "split", "pos", "split_rows")


def split_permuted_delivered(spark, sf_dir):
    corpus = positions(natural_order(delivered_splits(spark, sf_dir)))
    return permute_splits(corpus, HOLDOUT).select("doc_id", "split", "pos", "split_rows")


def split_limit(spark, sf_dir):
    return assign_splits(train_only(documents(spark, sf_dir)), LIMITED).select("doc_id", "split")


def split_delivered(spark, sf_dir):
    return assign_splits(delivered_splits(spark, sf_dir), HOLDOUT).select("doc_id", "split")


def split_file_order(spark, sf_dir):
    only_limits = PrepareParams(n_train=100)
    return assign_splits(train_only(documents(spark, sf_dir)), only_limits).select("doc_id", "split")


def split_size_report(spark, sf_dir):
    corpus = train_only(documents(spark, sf_dir))
    full = PrepareParams(n_val=LIMITED.n_val, n_test=LIMITED.n_test)
    return split_sizes(assign_splits(corpus, full), assign_splits(corpus, LIMITED), LIMITED)


def splits_round_trip(spark, sf_dir):
    path = shared_folder(spark, "splits")
    write_splits(assign_splits(train_only(documents(spark, sf_dir)), HOLDOUT).select("doc_id", "text", "split"), path)
    back = read_corpus(spark, path)
    return back.groupBy("split", "split_rows").agg(
        F.count("*").alias("docs"),
        F.sum(F.length("text")).alias("chars"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )


# Tokens


def vocab_frequency(spark, sf_dir):
    return vocab_a(spark, sf_dir)


def encode_corpus(spark, sf_dir):
    docs = texts(full_texts(spark, sf_dir))
    return shown(encode(docs, vocab_a(spark, sf_dir), SPECIALS, ["doc_id"]).drop("attention_mask"), "input_ids")


def encode_corpus_join(spark, sf_dir):
    docs = texts(full_texts(spark, sf_dir))
    return shown(word_ids_by_join(docs, vocab_a(spark, sf_dir), SPECIALS, ["doc_id"]), "input_ids")


def attention_mask(spark, sf_dir):
    docs = texts(full_texts(spark, sf_dir))
    return shown(
        encode(docs, vocab_a(spark, sf_dir), SPECIALS, ["doc_id"]).select("doc_id", "attention_mask"), "attention_mask"
    )


def repeated_vocabulary(spark, sf_dir):
    """The vocabulary with every token of an even id once more, under an id of its own."""
    vocab = vocab_a(spark, sf_dir)
    again = vocab.where("id > 3 and id % 2 = 0").select("token", (F.col("id") + VOCAB_SIZE).alias("id"))
    return vocab.unionByName(again)


def encode_repeated_tokens(spark, sf_dir):
    """Both forms on a vocabulary with repeated tokens and on documents that are there twice."""
    vocab = settled(repeated_vocabulary(spark, sf_dir))
    docs = texts(spread_texts(spark, sf_dir))
    twice = docs.unionByName(docs)
    forms = [
        encode(twice, vocab, SPECIALS, ["doc_id"], form=form).withColumn("form", F.lit(form)) for form in ("lookup", "join")
    ]
    return shown(forms[0].unionByName(forms[1]).drop("attention_mask"), "input_ids")


def encode_prompt_ids(spark, sf_dir):
    ids = encode_prompts(prompts(spark, sf_dir), vocab_a(spark, sf_dir), SPECIALS, ["conv_id", "turn"])
    return shown(ids.drop("attention_mask"), "input_ids")


def encoded_ids(spark, sf_dir, vocab):
    return encode(texts(full_texts(spark, sf_dir)), vocab, SPECIALS, ["doc_id"])


def decode_tokens(spark, sf_dir):
    vocab = settled(vocab_a(spark, sf_dir))  # looked up twice, counted once
    return decode(encoded_ids(spark, sf_dir, vocab), vocab, SPECIALS, ["doc_id"])


def decode_join(spark, sf_dir):
    vocab = settled(vocab_a(spark, sf_dir))
    return decode(encoded_ids(spark, sf_dir, vocab), vocab, SPECIALS, ["doc_id"], form="join")


def decode_skips_specials(spark, sf_dir):
    """Ids 4 and 5 as turn end and as one more special token."""
    vocab = settled(vocab_a(spark, sf_dir))
    specials = Specials(eos=SPECIALS.eos, bos=SPECIALS.bos, unk=SPECIALS.unk, pad=SPECIALS.pad, eot=4, others=(5,))
    return decode(encoded_ids(spark, sf_dir, vocab), vocab, specials, ["doc_id"])


def vocab_p(spark, sf_dir):
    return piece_vocabulary(full_texts(spark, sf_dir), VOCAB_SIZE)


def vocab_pieces(spark, sf_dir):
    return vocab_p(spark, sf_dir)


def piece_ids(spark, sf_dir, vocab):
    docs = texts(full_texts(spark, sf_dir))
    return encode(docs, None, SPECIALS, ["doc_id"], codec=piece_encoder(vocab, SPECIALS))


def encode_pieces(spark, sf_dir):
    return shown(piece_ids(spark, sf_dir, vocab_p(spark, sf_dir)).drop("attention_mask"), "input_ids")


def encode_prompt_pieces(spark, sf_dir):
    codec = piece_encoder(vocab_p(spark, sf_dir), SPECIALS)
    ids = encode_prompts(prompts(spark, sf_dir), None, SPECIALS, ["conv_id", "turn"], codec=codec)
    return shown(ids.drop("attention_mask"), "input_ids")


def decode_pieces(spark, sf_dir):
    """Every text, given back by its ids."""
    vocab = settled(vocab_p(spark, sf_dir))
    return decode(piece_ids(spark, sf_dir, vocab), None, SPECIALS, ["doc_id"], codec=piece_decoder(vocab))


def prepare_pieces(spark, sf_dir):
    """Holdout, pieces and packing."""
    corpus = train_only(full_texts(spark, sf_dir))
    codec = piece_encoder(vocab_p(spark, sf_dir), SPECIALS)
    return shown(prepare_corpus(corpus, None, SPECIALS, HOLDOUT, codec).drop("attention_mask"), "input_ids")


# Packing and collation


def pack_group_ids(spark, sf_dir):
    placed = positions(by_language(documents(spark, sf_dir)))
    return packing_groups(placed, 12, 30).select("doc_id", "split", "pos", "shard", "batch")


def pack_blocks(spark, sf_dir):
    blocks = pack_batches(positions(encoded_by_language(spark, sf_dir)), SPECIALS, LENGTH, 1, BATCH_ROWS)
    return shown(blocks.drop("shard", "attention_mask"), "input_ids")


def pack_sharded(spark, sf_dir):
    blocks = pack_batches(positions(encoded_by_language(spark, sf_dir)), SPECIALS, LENGTH, 12, 30)
    return shown(blocks, "input_ids", "attention_mask")


def packed_by_udtf(spark, sf_dir):
    """The blocks of ``pack_blocks``, by a table function."""
    placed = packing_groups(positions(encoded_by_language(spark, sf_dir)), 1, BATCH_ROWS)
    blocks = pack_streamed(placed, LENGTH, SPECIALS.bos)
    return shown(blocks.drop("shard", "attention_mask"), "input_ids")


def pack_one_stream(spark, sf_dir):
    counted = token_counts(by_language(full_texts(spark, sf_dir)))
    blocks = pack_global(encoded_by_language(spark, sf_dir), SPECIALS, LENGTH, counted)
    return shown(blocks.drop("attention_mask"), "input_ids")


def pack_stats(spark, sf_dir):
    corpus = by_language(full_texts(spark, sf_dir)).drop("order_key", "order_bucket")
    return corpus_accounts(corpus, PrepareParams(max_seq_length=LENGTH, shards=1, batch_rows=BATCH_ROWS))


def truncated(spark, sf_dir, length=LENGTH):
    return positions(truncate_documents(encoded_by_language(spark, sf_dir), length))


def truncate_sequences(spark, sf_dir):
    rows = truncated(spark, sf_dir).select("doc_id", "split", "input_ids", "attention_mask")
    return shown(rows, "input_ids", "attention_mask")


def collate_left_pad(spark, sf_dir):
    rows = collate(truncated(spark, sf_dir), SPECIALS, batch_size=2)
    return shown(rows.drop("labels"), "input_ids", "attention_mask")


def collate_right_pad(spark, sf_dir):
    rows = collate(truncated(spark, sf_dir), SPECIALS, batch_size=4, side="right")
    return shown(rows, "input_ids", "attention_mask", "labels")


def collate_drop_last(spark, sf_dir):
    rows = collate(truncated(spark, sf_dir), SPECIALS, batch_size=7, drop_last=True)
    return shown(rows.select("split", "batch", "pos", "labels"), "labels")


def collate_labels(spark, sf_dir):
    rows = collate(truncated(spark, sf_dir), SPECIALS, batch_size=8)
    return shown(rows.select("split", "batch", "pos", "labels"), "labels")


def collate_pad_is_eos(spark, sf_dir):
    no_pad = Specials(eos=SPECIALS.eos, bos=SPECIALS.bos, unk=SPECIALS.unk)
    rows = collate(truncated(spark, sf_dir), no_pad, batch_size=2)
    return shown(rows.drop("attention_mask"), "input_ids", "labels")


# Vocabularies


def vocab_invert(spark, sf_dir):
    both = vocab_a(spark, sf_dir).unionByName(vocab_b(spark, sf_dir))
    return V.invert(both)


def vocab_shared_ids(spark, sf_dir):
    return V.shared_ids(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir))


def vocab_token_sets(spark, sf_dir):
    return V.token_membership(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir))


def vocab_common_ids(spark, sf_dir):
    return V.common_ids(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir))


def vocab_overlap_summary(spark, sf_dir):
    return V.overlap_summary(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir))


def vocab_id_lookup(spark, sf_dir):
    """Tokens of the ids that label the embedding rows, and of the last row's id."""
    rows = table(spark, sf_dir, "embeddings")
    ids = rows.select(F.col("label").alias("id")).union(rows.select(F.max("vec_id").cast("int") * 10)).distinct()
    return V.lookup_ids(ids, vocab_a(spark, sf_dir), vocab_b(spark, sf_dir))


def vocab_head_tail(spark, sf_dir):
    return head_tail(V.shared_ids(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir)), "id", 3, 3)


def freeze_id_list(spark, sf_dir):
    path = shared_folder(spark, "freeze-ids")
    write_ids(V.freeze_ids(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir), matrix(spark, sf_dir)), path)
    return read_ids(spark, path)


def freeze_bitmap(spark, sf_dir):
    """Shared ids that have a matrix row, as the meet of two sets, and their number."""
    shared = id_bitmaps(V.shared_ids(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir)))
    met = settled(both(shared, id_bitmaps(matrix(spark, sf_dir), "vec_id")))
    ids = ids_of(met).select(F.lit("id").alias("what"), F.col("id").alias("value"))
    return ids.unionByName(id_count(met).select(F.lit("ids").alias("what"), F.col("ids").alias("value")))


def bitmap_members(spark, sf_dir):
    """Which documents' ids are a vector's or a customer's, far ids and negative ones among them."""
    far = F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") * 40_009).otherwise(F.col("doc_id"))
    asked = documents(spark, sf_dir).select("doc_id", far.alias("id"))
    some = table(spark, sf_dir, "embeddings").select((-F.col("vec_id") * 3 * 40_009).alias("id"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return with_membership(asked, settled(either(id_bitmaps(some), id_bitmaps(customers))), "id")


def freeze_counts(spark, sf_dir):
    return V.freeze_counts(vocab_a(spark, sf_dir), vocab_b(spark, sf_dir), matrix(spark, sf_dir))


def label_ids_sorted(spark, sf_dir):
    return unique_sorted(table(spark, sf_dir, "embeddings").select(F.col("label").alias("id")))


def eot_ids(spark, sf_dir):
    chat = [("</s>", VOCAB_SIZE), ("<end_of_turn>", VOCAB_SIZE + 1)]
    chat_tokens = spark.createDataFrame(chat, "token STRING, id INT")
    return V.turn_end_ids(spark, vocab_a(spark, sf_dir).unionByName(chat_tokens), SPECIALS)


# Metrics and matrices


def token_loss(spark, sf_dir):
    return rounded(token_losses(steps(spark, sf_dir)), "loss")


def token_loss_bucketed(spark, sf_dir):
    """Losses of steps that a table holds in buckets, some of them ignored."""
    path = shared_folder(spark, "steps")
    stored = store_steps(partly_ignored(spark, sf_dir), path.rpartition("/")[2].replace("-", "_"), STEP_BUCKETS, path)
    return rounded(stored_token_losses(stored, STEP_BUCKETS), "loss")


def token_loss_by_sequence(spark, sf_dir):
    losses = sequence_losses(step_arrays(partly_ignored(spark, sf_dir)))
    return rounded(losses, "loss").withColumn("pos", F.col("pos").cast("long"))


def token_loss_gaps(spark, sf_dir):
    """Steps of some positions only: the next label is that of the next position there is."""
    some = steps(spark, sf_dir).where((F.col("seq_id") + F.col("pos") * 5) % 3 != 0)
    return rounded(token_losses(some), "loss")


def perplexity_overall(spark, sf_dir):
    return rounded(perplexity(token_losses(steps(spark, sf_dir))), "eval_loss", "perplexity")


def perplexity_exact_by_group(spark, sf_dir):
    losses = token_losses(partly_ignored(spark, sf_dir))
    whole = perplexity_exact(losses).withColumn("target", F.lit(-1))
    return rounded(perplexity_exact(losses, ["target"]).unionByName(whole), "eval_loss", "perplexity")


def l1_exact_totals(spark, sf_dir):
    return rounded(l1_exact(matrix(spark, sf_dir), label_row_ids(spark, sf_dir)), "total_l1", "frozen_l1")


def perplexity_by_sequence(spark, sf_dir):
    losses = sequence_losses(step_arrays(steps(spark, sf_dir)))
    return rounded(perplexity(losses), "eval_loss", "perplexity")


def perplexity_capped(spark, sf_dir):
    """Logits 200 times as large: mean losses whose exponentials pass the maximum are infinite."""
    sharp = steps(spark, sf_dir).withColumn("logits", F.transform("logits", lambda z: z.cast("double") * 200))
    return rounded(perplexity(token_losses(sharp), ["target"]), "eval_loss", "perplexity")


def perplexity_nan(spark, sf_dir):
    """Logits of every eleventh sequence are no numbers."""
    logits = F.when(F.col("seq_id") % 11 == 0, F.transform("logits", lambda z: z * float("nan"))).otherwise(F.col("logits"))
    losses = token_losses(steps(spark, sf_dir).withColumn("logits", logits))
    by = perplexity(losses, ["seq_id"])
    return by.groupBy(F.isnan("perplexity").alias("is_nan")).agg(
        F.count("*").alias("sequences"), F.count_if(F.isnan("eval_loss")).alias("nan_losses")
    )


def perplexity_by_group(spark, sf_dir):
    losses = token_losses(partly_ignored(spark, sf_dir))
    return rounded(perplexity(losses, ["target"]), "eval_loss", "perplexity")


def perplexity_empty(spark, sf_dir):
    """Sequences of one step each have no next token to predict."""
    single = steps(spark, sf_dir).withColumn("seq_id", F.col("seq_id") * 8 + F.col("pos")).withColumn("pos", F.lit(0))
    return perplexity(token_losses(single))


def label_row_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"))


def matrix_zero_rows(spark, sf_dir):
    """Zeroes the rows whose id occurs as a label."""
    zeroed = zero_rows(matrix(spark, sf_dir), label_row_ids(spark, sf_dir))
    parts = F.transform("embedding", lambda z: F.round(z.cast("double"), 6).cast("decimal(12,6)").cast("string"))
    return zeroed.select("vec_id", F.array_join(parts, ",").alias("embedding"))


def matrix_zero_by_bitmap(spark, sf_dir):
    zeroed = zero_rows_by_bitmap(matrix(spark, sf_dir), settled(id_bitmaps(label_row_ids(spark, sf_dir))))
    parts = F.transform("embedding", lambda z: F.round(z.cast("double"), 6).cast("decimal(12,6)").cast("string"))
    return zeroed.select("vec_id", F.array_join(parts, ",").alias("embedding"))


def matrix_output(spark, sf_dir):
    """Input and output matrix, the latter zeroed or not by flag."""
    rows, ids = matrix(spark, sf_dir), label_row_ids(spark, sf_dir)
    found = []
    for flag in (True, False):
        pair = zero_input_and_output(rows, rows, ids, include_output=flag)
        for name, part in zip(("input", "output"), pair, strict=True):
            found.append(part.select(F.lit(name).alias("matrix"), F.lit(flag).alias("flag"), "vec_id", all_zero().alias("zero")))
    return reduce(DataFrame.unionByName, found)


def all_zero() -> Column:
    return F.forall("embedding", lambda z: z == 0)


def matrix_l1(spark, sf_dir):
    rows, ids = matrix(spark, sf_dir), label_row_ids(spark, sf_dir)
    before = l1_totals(rows, ids).withColumn("state", F.lit("before"))
    after = l1_totals(zero_rows(rows, ids), ids).withColumn("state", F.lit("after"))
    return rounded(before.unionByName(after), "total_l1", "frozen_l1")


def frozen_matrix(spark, sf_dir):
    a, b, rows = vocab_a(spark, sf_dir), vocab_b(spark, sf_dir), matrix(spark, sf_dir)
    zeroed = freeze_matrix(a, b, rows)
    return zeroed.select("vec_id", all_zero().alias("frozen"))


# Chat text, user functions, preview


def strip_markers(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text").alias("text")
    marked = table(spark, sf_dir, "conversations").select("conv_id", "turn", line)
    return strip_role_markers(marked)


def strip_echoed_dialogue(spark, sf_dir):
    """Each turn echoed in front of its answer, as a model that repeats its prompt does."""
    said = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line")
    )
    answers = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("line").alias("answer"))
    echoed = said.join(answers, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.concat("line", F.lit("\n"), "answer").alias("text")
    )
    return strip_role_markers(echoed)


def batched_map(spark, sf_dir):
    """Lines of each document, by an Arrow function that returns more rows than it gets."""

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = pc.split_pattern(batch.column("text"), "\n")
        owner = pc.list_parent_indices(pieces)
        starts = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        line_no = np.arange(len(owner)) - starts[owner.to_numpy()]
        columns = [batch.column("doc_id").take(owner), pa.array(line_no, pa.int64()), pieces.flatten()]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "line_no", "line"])

    rows = documents(spark, sf_dir).select("doc_id", "text")
    return map_batches(rows, lines, "doc_id LONG, line_no LONG, line STRING")


def batched_groups(spark, sf_dir):
    """Rows and characters of each packing batch, by an Arrow function per batch."""

    def account(batch: pa.Table) -> pa.Table:
        head = batch.slice(0, 1).select(["split", "shard", "batch"])
        docs = pa.array([batch.num_rows], pa.int64())
        chars = pa.array([pc.sum(batch.column("n_chars")).as_py()], pa.int64())
        return head.append_column("docs", docs).append_column("chars", chars)

    docs = documents(spark, sf_dir).select("doc_id", "n_chars", F.col("lang").alias("split"))
    groups = packing_groups(positions(natural_order(docs)), 12, 30).select("split", "shard", "batch", "n_chars")
    schema = "split STRING, shard LONG, batch LONG, docs LONG, chars LONG"
    return map_groups(groups, ["split", "shard", "batch"], account, schema)


def preview_rows(spark, sf_dir):
    return preview(documents(spark, sf_dir).select("doc_id", "lang", "source", "text"), "doc_id")


# Whole runs


def prepare_blocks(spark, sf_dir):
    """The flagship: hold out, encode, pack."""
    blocks = prepare_corpus(train_only(full_texts(spark, sf_dir)), vocab_a(spark, sf_dir), SPECIALS, HOLDOUT)
    return shown(blocks.drop("attention_mask"), "input_ids")


def prepared(spark, sf_dir, params):
    return prepare_corpus(train_only(full_texts(spark, sf_dir)), vocab_a(spark, sf_dir), SPECIALS, params)


def prepare_collated(spark, sf_dir):
    """Packed blocks as batches of two, with labels."""
    rows = collate(prepared(spark, sf_dir, HOLDOUT), SPECIALS, batch_size=2)
    return shown(rows, "input_ids", "attention_mask", "labels")


def preview_blocks(spark, sf_dir):
    blocks = shown(prepared(spark, sf_dir, HOLDOUT).select("split", "pos", "input_ids"), "input_ids")
    return preview(blocks, ["split", "pos"], max_rows=5, max_width=30)


def prepare_global(spark, sf_dir):
    """A holdout and limits, each split packed as one stream."""
    blocks = prepared(spark, sf_dir, replace(LIMITED, grouping="global"))
    return shown(blocks.drop("attention_mask"), "input_ids")


def blocks_by_number(spark, sf_dir):
    """Blocks written to a store of files in order, read back beside their file's row of the manifest."""
    path = shared_folder(spark, "block-store")
    write_blocks(prepared(spark, sf_dir, HOLDOUT).select("split", "pos", "input_ids"), path, per_file=64)
    files = read_manifest(spark, path).drop("per_file")
    rows = read_blocks(spark, path).join(files, ["split", "file"])
    return shown(rows, "input_ids")


def blocks_of_range(spark, sf_dir):
    """The blocks of some numbers out of a store; files beside the range are not opened."""
    path = shared_folder(spark, "block-store")
    write_blocks(prepared(spark, sf_dir, HOLDOUT).select("split", "pos", "input_ids"), path, per_file=64)
    return shown(read_blocks(spark, path, "train", 20, 70).drop("file"), "input_ids")


def accounts_global(spark, sf_dir):
    corpus = train_only(full_texts(spark, sf_dir))
    return corpus_accounts(corpus, replace(LIMITED, grouping="global"))


def prepare_without_nulls(spark, sf_dir):
    """Texts of every seventh document are null and left out."""
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    corpus = train_only(full_texts(spark, sf_dir)).withColumn("text", text)
    params = replace(HOLDOUT, on_null="drop")
    blocks = prepare_corpus(corpus, vocab_a(spark, sf_dir), SPECIALS, params)
    return shown(blocks.drop("attention_mask"), "input_ids")


def prepare_file_order(spark, sf_dir):
    """No holdout: positions come from the files, and only the packing moves rows."""
    path, vocab = f"{sf_dir}/documents.parquet", vocab_a(spark, sf_dir)
    blocks = prepare_path(spark, path, vocab, SPECIALS, FILE_ORDER, spread_over=slots(spark))
    return shown(blocks.drop("attention_mask"), "input_ids")


def prepare_permuted(spark, sf_dir):
    """A holdout by arithmetic on the positions that the files give."""
    path, vocab = f"{sf_dir}/documents.parquet", vocab_a(spark, sf_dir)
    params = replace(HOLDOUT, shuffle="permuted")
    blocks = prepare_path(spark, path, vocab, SPECIALS, params, spread_over=slots(spark))
    return shown(blocks.drop("attention_mask"), "input_ids")


def prepare_file_limit(spark, sf_dir):
    """The first documents of the file, truncated."""
    params = PrepareParams(max_seq_length=LENGTH, n_train=100, use_packing=False)
    path, vocab = f"{sf_dir}/documents.parquet", vocab_a(spark, sf_dir)
    rows = prepare_path(spark, path, vocab, SPECIALS, params, spread_over=slots(spark))
    return shown(rows.drop("attention_mask"), "input_ids")


def prepare_delivered(spark, sf_dir):
    """A whole run over a directory of delivered splits, whose documents lie in the order of their ids."""
    path = shared_folder(spark, "delivered")
    # Files are numbered by range of ids, so that their order is that of the ids.
    ordered = delivered_splits(spark, sf_dir).repartitionByRange(slots(spark), "doc_id").sortWithinPartitions("split", "doc_id")
    write_splits(ordered.drop("doc_id"), path)
    params = PrepareParams(max_seq_length=LENGTH, shards=4, batch_rows=100)
    blocks = prepare_path(spark, path, vocab_a(spark, sf_dir), SPECIALS, params, spread_over=slots(spark))
    return shown(blocks.drop("attention_mask"), "input_ids")


def prepare_truncated(spark, sf_dir):
    params = PrepareParams(max_seq_length=LENGTH, n_val=30, n_test=50, use_packing=False)
    rows = prepare_corpus(train_only(full_texts(spark, sf_dir)), vocab_a(spark, sf_dir), SPECIALS, params)
    return shown(rows.drop("attention_mask"), "input_ids")


QUERIES: dict[str, Query] = {
    "corpus_scan": corpus_scan,
    "text_projection": text_projection,
    "shard_sample": shard_sample,
    "row_positions_any_id": row_positions_any_id,
    "split_any_id": split_any_id,
    "row_positions": row_positions,
    "seeded_shuffle": seeded_shuffle,
    "split_holdout": split_holdout,
    "seeded_permutation": seeded_permutation,
    "split_permuted": split_permuted,
    "split_permuted_delivered": split_permuted_delivered,
    "split_limit": split_limit,
    "split_delivered": split_delivered,
    "split_file_order": split_file_order,
    "split_sizes": split_size_report,
    "splits_round_trip": splits_round_trip,
    "vocab_frequency": vocab_frequency,
    "encode_corpus": encode_corpus,
    "encode_corpus_join": encode_corpus_join,
    "encode_repeated_tokens": encode_repeated_tokens,
    "attention_mask": attention_mask,
    "encode_prompts": encode_prompt_ids,
    "decode_tokens": decode_tokens,
    "decode_join": decode_join,
    "vocab_pieces": vocab_pieces,
    "encode_pieces": encode_pieces,
    "encode_prompt_pieces": encode_prompt_pieces,
    "decode_pieces": decode_pieces,
    "prepare_pieces": prepare_pieces,
    "decode_skips_specials": decode_skips_specials,
    "pack_groups": pack_group_ids,
    "pack_blocks": pack_blocks,
    "packed_by_udtf": packed_by_udtf,
    "pack_sharded": pack_sharded,
    "pack_global": pack_one_stream,
    "pack_stats": pack_stats,
    "truncate_sequences": truncate_sequences,
    "collate_left_pad": collate_left_pad,
    "collate_right_pad": collate_right_pad,
    "collate_labels": collate_labels,
    "collate_drop_last": collate_drop_last,
    "collate_pad_is_eos": collate_pad_is_eos,
    "vocab_invert": vocab_invert,
    "vocab_shared_ids": vocab_shared_ids,
    "vocab_token_sets": vocab_token_sets,
    "vocab_common_ids": vocab_common_ids,
    "vocab_overlap_summary": vocab_overlap_summary,
    "vocab_id_lookup": vocab_id_lookup,
    "vocab_head_tail": vocab_head_tail,
    "freeze_ids": freeze_id_list,
    "freeze_counts": freeze_counts,
    "freeze_bitmap": freeze_bitmap,
    "bitmap_members": bitmap_members,
    "unique_sorted_ids": label_ids_sorted,
    "eot_ids": eot_ids,
    "token_loss": token_loss,
    "token_loss_bucketed": token_loss_bucketed,
    "token_loss_by_sequence": token_loss_by_sequence,
    "token_loss_gaps": token_loss_gaps,
    "perplexity": perplexity_overall,
    "perplexity_by_sequence": perplexity_by_sequence,
    "perplexity_exact": perplexity_exact_by_group,
    "l1_exact": l1_exact_totals,
    "perplexity_capped": perplexity_capped,
    "perplexity_nan": perplexity_nan,
    "perplexity_by_group": perplexity_by_group,
    "perplexity_empty": perplexity_empty,
    "matrix_zero_rows": matrix_zero_rows,
    "matrix_zero_by_bitmap": matrix_zero_by_bitmap,
    "matrix_output": matrix_output,
    "matrix_l1": matrix_l1,
    "frozen_matrix": frozen_matrix,
    "strip_role_markers": strip_markers,
    "strip_echoed_dialogue": strip_echoed_dialogue,
    "batched_map": batched_map,
    "batched_groups": batched_groups,
    "preview_rows": preview_rows,
    "prepare_corpus": prepare_blocks,
    "prepare_file_order": prepare_file_order,
    "prepare_truncated": prepare_truncated,
    "prepare_collated": prepare_collated,
    "preview_blocks": preview_blocks,
    "prepare_global": prepare_global,
    "accounts_global": accounts_global,
    "prepare_without_nulls": prepare_without_nulls,
    "prepare_permuted": prepare_permuted,
    "blocks_by_number": blocks_by_number,
    "blocks_of_range": blocks_of_range,
    "prepare_file_limit": prepare_file_limit,
    "prepare_delivered": prepare_delivered,
}
