"""Vocabularies as tables ``(token STRING, id INT)``, and their comparison.

Where a token occurs with several ids, encoding takes the least one; where an id occurs with several
tokens, the greatest one counts wherever tokens are looked up by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusweave.functions.words import words
from corpusweave.params import Specials

# Tokens that end a turn in common chat formats.
TURN_END_TOKENS = [
    "<|eot_id|>",
    "<|im_end|>",
    "<|endoftext|>",
    "</s>",
    "<end_of_turn>",
    "<eot_id>",
    "<|eot|>",
    "<EOT>",
]

SPECIAL_TOKENS = {"<pad>": 0, "<eos>": 1, "<bos>": 2, "<unk>": 3}
SPECIALS = Specials(pad=0, eos=1, bos=2, unk=3)


def word_counts(corpus: DataFrame) -> DataFrame:
    """Occurrences of each word; hot words are counted before the shuffle."""
    return (
        corpus.select(F.explode(words(F.col("text"))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("occurrences"))
    )


def frequency_vocabulary(corpus: DataFrame, size: int) -> DataFrame:
    """The most frequent words after the special tokens, as a stand-in vocabulary."""
    top = word_counts(corpus).orderBy(F.desc("occurrences"), "token").limit(size - len(SPECIAL_TOKENS))
    rank = F.row_number().over(W.orderBy(F.desc("occurrences"), "token"))
    frequent = top.select("token", (rank + (len(SPECIAL_TOKENS) - 1)).cast("int").alias("id"))
    special = corpus.sparkSession.createDataFrame(list(SPECIAL_TOKENS.items()), "token STRING, id INT")
    return frequent.unionByName(special)


def invert(vocab: DataFrame) -> DataFrame:
    """One token per id; where several share an id the greatest token stays."""
    return vocab.groupBy("id").agg(F.max("token").alias("token"))


def token_membership(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every token with the vocabularies that hold it: both, only_first, only_second."""
    a = first.select("token", F.lit(True).alias("in_first")).distinct()
    b = second.select("token", F.lit(True).alias("in_second")).distinct()
    where = F.when(F.col("in_second").isNull(), "only_first").when(F.col("in_first").isNull(), "only_second")
    return a.join(b, "token", "full_outer").select("token", where.otherwise("both").alias("membership"))


def common_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids in use in both vocabularies, with the token of each."""
    a, b = invert(first), invert(second)
    return a.select("id", F.col("token").alias("token_1")).join(b.select("id", F.col("token").alias("token_2")), "id")


def shared_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids that stand for the same token in both vocabularies."""
    return common_ids(first, second).where(F.col("token_1") == F.col("token_2")).select("id")


def overlap_summary(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row of ten counts that compare two vocabularies by token and by id."""
    a = first.select("token", F.col("id").alias("id_1"))
    b = second.select("token", F.col("id").alias("id_2"))
    in_1, in_2 = F.col("id_1").isNotNull(), F.col("id_2").isNotNull()
    same_id = F.col("id_1") == F.col("id_2")
    by_token = a.join(b, "token", "full_outer").agg(
        F.count_if(in_1).alias("vocab_size_1"),
        F.count_if(in_2).alias("vocab_size_2"),
        F.count_if(in_1 & in_2).alias("shared_token_count"),
        F.count_if(same_id).alias("same_token_same_id"),
        F.count_if(~same_id).alias("same_token_diff_id"),
        F.count_if(~in_2).alias("only_in_1"),
        F.count_if(~in_1).alias("only_in_2"),
    )
    same_token = F.col("token_1") == F.col("token_2")
    by_id = common_ids(first, second).agg(
        F.count("*").alias("same_id_count"),
        F.count_if(same_token).alias("same_id_same_token"),
        F.count_if(~same_token).alias("same_id_diff_token"),
    )
    # The names of the measures.
    measures = [
        "vocab_size_1",
        "vocab_size_2",
        "shared_token_count",
        "same_token_same_id",
        "same_token_diff_id",
        "same_id_count",
        "same_id_same_token",
        "same_id_diff_token",
        "only_in_1",
        "only_in_2",
    ]
    both = by_token.unionByName(by_id, allowMissingColumns=True)
    return both.agg(*[F.max(m).alias(m) for m in measures])


def lookup_ids(ids: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The token of each asked id in both vocabularies; null where there is none."""
    a = invert(first).withColumnRenamed("token", "token_1")
    b = invert(second).withColumnRenamed("token", "token_2")
    return ids.select("id").join(a, "id", "left").join(b, "id", "left")


def flag_ids(ids: DataFrame, matrix: DataFrame) -> DataFrame:
    """Ids with ``valid``: whether the matrix has a row for the id."""
    rows = matrix.agg(F.count("*")).scalar()
    return ids.select("id", (F.col("id") < rows).alias("valid"))


def freeze_ids(first: DataFrame, second: DataFrame, matrix: DataFrame) -> DataFrame:
    """Sorted ids that keep their token across vocabularies and have a matrix row."""
    return flag_ids(shared_ids(first, second), matrix).where("valid").select("id").distinct().orderBy("id")


def freeze_counts(first: DataFrame, second: DataFrame, matrix: DataFrame) -> DataFrame:
    """How many shared ids lie inside and outside the matrix."""
    return flag_ids(shared_ids(first, second), matrix).groupBy("valid").agg(F.count("*").alias("ids"))


def turn_end_ids(
    spark: SparkSession, vocab: DataFrame, specials: Specials, candidates: list[str] = TURN_END_TOKENS
) -> DataFrame:
    """Ids that end a turn: known candidates, EOS and the tokenizer's own; EOS at least."""
    wanted = spark.createDataFrame([(c,) for c in candidates], "token STRING")
    known = vocab.join(F.broadcast(wanted), "token", "left_semi").select(F.col("id").cast("int").alias("id"))
    if specials.unk is not None:
        known = known.where(F.col("id") != specials.unk)
    own = [(i,) for i in (specials.eot, specials.eos) if i is not None]
    return known.unionByName(spark.createDataFrame(own, "id INT")).distinct()
