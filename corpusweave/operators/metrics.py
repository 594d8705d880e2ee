"""Token losses and perplexity from logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.functions.exact import exact_sums
from corpusweave.functions.sequences import cross_entropy
from corpusweave.functions.words import required
from corpusweave.params import IGNORE_LABEL

MAX_PERPLEXITY = 1e10


def token_losses(steps: DataFrame) -> DataFrame:
    """Loss of each position against the label of the next one.

    Takes one row per step: ``seq_id, pos, logits, label``. The next step is that of the next
    greater ``pos``, whatever lies between; a null label is an error. Targets are found among labels alone, and
    logits move once, to meet them, those of ignored targets too: where a sequence's steps come in one row,
    ``sequence_losses`` moves nothing.
    """
    label = required(F.col("label"), "label")
    after = F.lead("checked").over(W.partitionBy("seq_id").orderBy("pos"))
    labels = steps.select("seq_id", "pos", label.alias("checked"))
    targets = labels.withColumn("target", after).where(F.col("target") != IGNORE_LABEL).drop("checked")
    return (
        steps.select("seq_id", "pos", "logits")
        .join(targets.hint("merge"), ["seq_id", "pos"])
        .select("seq_id", "pos", "target", cross_entropy(F.col("logits"), F.col("target")).alias("loss"))
    )


def sequence_losses(sequences: DataFrame) -> DataFrame:
    """The same from one row per sequence: ``seq_id, logits ARRAY<ARRAY>, labels ARRAY``.

    Nothing moves: each step is paired with its next label inside the row. A null label is an error.
    """
    pairs = F.greatest(F.size("labels") - 1, F.lit(0))
    shifted = sequences.select(
        "seq_id", F.slice("logits", F.lit(1), pairs).alias("logits"), F.slice("labels", F.lit(2), pairs).alias("target")
    )
    steps = shifted.select("seq_id", F.posexplode(F.arrays_zip("logits", "target")).alias("pos", "step"))
    target = required(F.col("step.target"), "labels").alias("target")
    return (
        steps.select("seq_id", "pos", target, "step.logits")
        .where(F.col("target") != IGNORE_LABEL)
        .select("seq_id", "pos", "target", cross_entropy(F.col("logits"), F.col("target")).alias("loss"))
    )


def perplexity_of(mean_loss: Column) -> Column:
    """``exp`` of a mean loss; above the maximum it is infinite, NaN stays NaN."""
    value = F.exp(mean_loss)
    return F.when(F.isnan(mean_loss), mean_loss).when(value > MAX_PERPLEXITY, F.lit(float("inf"))).otherwise(value)


def perplexity(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``eval_loss`` and ``perplexity`` over all tokens, or per group.

    With no token at all both are infinite.
    """
    mean = losses.groupBy(*(by or [])).agg(F.avg("loss").alias("eval_loss"))
    loss = F.coalesce("eval_loss", F.lit(float("inf")))
    return mean.select(*(by or []), loss.alias("eval_loss"), perplexity_of(loss).alias("perplexity"))


def perplexity_exact(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same, from a sum that is exact: bit for bit equal however the losses are partitioned."""
    summed = exact_sums(losses, by or [], loss=F.col("loss"))
    mean = F.when(F.col("n_loss") > 0, F.col("loss") / F.col("n_loss")).otherwise(float("inf"))
    return summed.select(*(by or []), mean.alias("eval_loss"), perplexity_of(mean).alias("perplexity"))
