"""Packing encoded documents into blocks of one length, or truncating them.

A block is BOS and ``length - 1`` tokens of the concatenated documents; what a packing
group has left over is dropped. Offsets come from windows over documents, and a document
is cut once into the pieces that each block takes: rows move as whole pieces, never
as single tokens. A group is bounded by its rows, a block by its length; a split may be of
any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.functions.integers import int_div
from corpusweave.functions.sequences import ones, prepend_id, truncate
from corpusweave.operators.order import positions, run_starts, running_totals
from corpusweave.params import Specials, check_block_length

GROUP = ["split", "shard", "batch"]
# A group as one number: its shard, then its batch in the shard.
BATCH_BITS = 40


def packing_groups(rows: DataFrame, shards: int, batch_rows: int) -> DataFrame:
    """Add ``shard`` and ``batch``: contiguous shards of a split, cut into batches.

    Takes ``pos`` and ``split_rows``. The first ``split_rows mod shards`` shards hold
    one row more; a split with fewer rows than shards has one shard per row.
    """
    pos = F.col("pos")
    n_shards = F.least(F.lit(max(1, shards)).cast("long"), F.col("split_rows"))
    base, extra = int_div(F.col("split_rows"), n_shards), F.col("split_rows") % n_shards
    in_long_shards = extra * (base + 1)
    shard = F.when(pos < in_long_shards, int_div(pos, base + 1)).otherwise(extra + int_div(pos - in_long_shards, base))
    first = F.col("shard") * base + F.least(F.col("shard"), extra)
    return rows.withColumn("shard", shard).withColumn("batch", int_div(pos - first, batch_rows))


def group_offsets(rows: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Add ``start``, the tokens before a document in its group, and ``total``."""
    group = W.partitionBy(*GROUP)
    upto = group.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("start", F.sum(size).over(upto) - F.col(size)).withColumn("total", F.sum(size).over(group))


def cut_blocks(placed: DataFrame, group: list[str], length: int, bos: int) -> DataFrame:
    """Blocks of documents whose ``start`` and group ``total`` are known."""
    chunk = length - 1
    first = int_div(F.col("start"), chunk)
    last_of_doc = int_div(F.col("start") + F.size("input_ids") - 1, chunk)
    last_full = int_div(F.col("total"), chunk) - 1
    pieces = placed.where(first <= last_full).select(
        *group, "start", "input_ids", F.explode(F.sequence(first, F.least(last_of_doc, last_full))).alias("block")
    )
    skip = F.greatest(F.col("block") * chunk - F.col("start"), F.lit(0))
    stop = F.least((F.col("block") + 1) * chunk - F.col("start"), F.size("input_ids"))
    ids = F.slice("input_ids", (skip + 1).cast("int"), (stop - skip).cast("int"))
    gathered = (
        pieces.select(*group, "block", F.struct("start", ids.alias("ids")).alias("piece"))
        .groupBy(*group, "block")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    )
    blocks = gathered.select(*group, "block", prepend_id(F.flatten("pieces.ids"), bos).alias("input_ids"))
    return blocks.withColumn("attention_mask", ones(F.col("input_ids")))


def pack_batches(
    docs: DataFrame, specials: Specials, length: int, shards: int = 1, batch_rows: int = 1000
) -> DataFrame:
    """Pack every batch of rows alone; blocks carry ``split, shard, batch, block``.

    Takes ``split, pos, split_rows, input_ids``. The documents move once, to their
    group; blocks form where the group already is.
    """
    check_block_length(length)
    rows = docs.select("split", "pos", "split_rows", "input_ids", F.size("input_ids").cast("long").alias("n_tokens"))
    placed = group_offsets(packing_groups(rows, shards, batch_rows))
    return cut_blocks(placed, GROUP, length, specials.bos)


def number_blocks(blocks: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """Add ``pos``, the place of a block in its split, by shard, batch and block.

    ``groups`` has one row per document with its group and ``n_tokens``, as counted from the texts:
    blocks per group are counted and stored once and add up to running totals, and blocks, which lie by group already, do not move.
    """
    order = (F.shiftleft("shard", BATCH_BITS) + F.col("batch")).alias("group")
    totals = groups.groupBy(*GROUP).agg(int_div(F.sum("n_tokens"), length - 1).alias("blocks"))
    summed = running_totals(totals.select("split", order, "blocks"), ["split"], "group", ["blocks"])
    starts = summed.select(
        "split",
        F.shiftright("group", BATCH_BITS).alias("shard"),
        F.col("group").bitwiseAND((1 << BATCH_BITS) - 1).alias("batch"),
        F.col("before_blocks").alias("first"),
    )
    # Every group is there; an inner join would have Spark test the group's expression for null at the scan.
    placed = blocks.join(starts.hint("merge"), GROUP, "left")
    return placed.select(*GROUP, "block", (F.col("first") + F.col("block")).alias("pos"), "input_ids", "attention_mask")


def pack_global(docs: DataFrame, specials: Specials, length: int, counted: DataFrame | None = None) -> DataFrame:
    """Pack each split as one stream, so that less than one block of it is lost.

    Takes ``split, doc_id, order_key, order_bucket, input_ids``. ``counted`` may give
    ``split, order_bucket, n_tokens`` of the same documents from their texts, so that the
    pass that sums runs does not encode.
    """
    check_block_length(length)
    size = F.size("input_ids").cast("long").alias("n_tokens")
    rows = docs.select("split", "doc_id", "order_key", "order_bucket", "input_ids", size)
    starts = run_starts(rows if counted is None else counted, weight="n_tokens")
    placed = positions(rows, weight="n_tokens", starts=starts).withColumnRenamed("split_weight", "total")
    return cut_blocks(placed, ["split"], length, specials.bos)


def truncate_documents(docs: DataFrame, length: int) -> DataFrame:
    """The first ``length`` tokens of each document; BOS is not added, EOS may go."""
    if length < 1:
        raise ValueError("length must be at least 1")
    cut = docs.withColumn("input_ids", truncate(F.col("input_ids"), length))
    return cut.withColumn("attention_mask", truncate(F.col("attention_mask"), length))


def packing_accounts(groups: DataFrame, length: int) -> DataFrame:
    """Blocks, tokens in and tokens dropped per split.

    Takes one row per document with its group and ``n_tokens``; no ids are needed.
    """
    check_block_length(length)
    totals = groups.groupBy(*GROUP).agg(F.sum("n_tokens").alias("total"))
    chunk = length - 1
    blocks = int_div(F.col("total"), chunk)
    return totals.groupBy("split").agg(
        F.sum(blocks).alias("blocks"),
        F.sum("total").alias("tokens_in"),
        F.sum(F.col("total") - blocks * chunk).alias("tokens_dropped"),
    )
