"""Logits that stay: steps stored in buckets of ``(seq_id, pos)``, and losses that bring the targets to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.functions.sequences import cross_entropy
from corpusweave.functions.words import required
from corpusweave.params import IGNORE_LABEL

KEY = ["seq_id", "pos"]


def store_steps(steps: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Writes ``seq_id, pos, logits, label`` as a bucketed table and gives it back.

    The one move of the logits; each bucket is a file. Choose ``buckets`` so that the targets of one, some 30 bytes a
    step, fit in a task's memory. With ``path`` the table lies there and not in the warehouse.
    """
    writer = steps.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return steps.sparkSession.table(name)


def stored_token_losses(steps: DataFrame, buckets: int) -> DataFrame:
    """``token_losses`` of a table of ``store_steps``, row for row, without a move or a sort of the logits.

    Labels move twice, to find the next one of their sequence and to go to the bucket of their step; those of
    ignored targets go no further than the first. Each bucket's targets become a hash table that its logits pass.
    """
    label = required(F.col("label"), "label")
    after = F.lead("checked").over(W.partitionBy("seq_id").orderBy("pos"))
    labels = steps.select(*KEY, label.alias("checked"))
    targets = labels.withColumn("target", after).where(F.col("target") != IGNORE_LABEL).drop("checked")
    there = targets.repartition(buckets, *KEY).hint("shuffle_hash")
    met = steps.select(*KEY, "logits").join(there, KEY)
    return met.select(*KEY, "target", cross_entropy(F.col("logits"), F.col("target")).alias("loss"))
