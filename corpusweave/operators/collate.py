"""Batches of padded rows with labels for a causal language model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.functions.integers import int_div
from corpusweave.functions.sequences import labels_of, pad_left, pad_right
from corpusweave.params import Specials


def collate(
    rows: DataFrame, specials: Specials, batch_size: int = 2, side: str = "left", drop_last: bool = False
) -> DataFrame:
    """Pad each run of ``batch_size`` rows of a split to its longest row.

    Takes ``split, pos, input_ids, attention_mask``: truncated rows or packed blocks. A missing pad token falls back to
    EOS; labels ignore every pad id, which then includes real EOS tokens. ``drop_last`` leaves out a batch that lacks rows.
    """
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    pad_id = specials.with_pad_fallback().pad
    pad = pad_left if side == "left" else pad_right
    batch = int_div(F.col("pos"), batch_size)
    together = W.partitionBy("split", "batch")
    width = F.max(F.size("input_ids")).over(together)
    sized = rows.withColumn("batch", batch).withColumn("width", width)
    if drop_last:
        sized = sized.withColumn("members", F.count("*").over(together)).where(F.col("members") == batch_size)
    padded = sized.select(
        "split",
        "batch",
        "pos",
        pad(F.col("input_ids"), F.col("width"), pad_id).alias("input_ids"),
        pad(F.col("attention_mask"), F.col("width"), 0).alias("attention_mask"),
    )
    return padded.withColumn("labels", labels_of(F.col("input_ids"), pad_id))
