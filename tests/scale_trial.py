"""Preparation on a larger, skewed copy of the documents.

    python tests/scale_trial.py NEW_FOLDER [COPIES]

Writes COPIES times the sf0.1 documents, a third of them in one split with one and the same
text, plus one document of three million words, then times whole runs and checks that the
blocks account for every token.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusweave import PrepareParams, corpus_accounts, prepare_corpus, prepare_path  # noqa: E402
from corpusweave.operators.encode import encode, texts  # noqa: E402
from corpusweave.plans.queries import SPECIALS, documents, vocab_a  # noqa: E402
from corpusweave.session import local_session, settled  # noqa: E402

SF_DIR = "/root/testdata/sf0.1"


def write_corpus(spark, path: str, copies: int) -> None:
    docs = documents(spark, SF_DIR)
    one_text = docs.where("doc_id = 1").first().text
    many = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    hot = F.col("copy") < copies // 3
    rows = many.select(
        (F.col("copy").cast("long") * 10_000 + F.col("doc_id")).alias("doc_id"),
        F.when(hot, one_text).otherwise(F.col("text")).alias("text"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("part"), F.col("copy") % 5)).alias("split"),
    )
    long_text = F.repeat(F.lit("the and of "), 1_000_000)
    last_id = F.lit(copies * 10_000).cast("long").alias("doc_id")
    giant = spark.range(1).select(last_id, long_text.alias("text"), F.lit("hot").alias("split"))
    rows.unionByName(giant).repartitionByRange(64, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def main() -> None:
    folder, copies = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 40
    path = f"{folder}/corpus.parquet"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    if not os.path.exists(path):
        write_corpus(spark, path, copies)
    vocab = settled(vocab_a(spark, SF_DIR))
    by_split = spark.read.parquet(path)
    as_train = by_split.withColumn("split", F.lit("train"))

    def timed(name, rows):
        start = time.time()
        got = rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.size("input_ids")).alias("ids")).collect()
        n_rows, n_ids = sum(r.rows for r in got), sum(r.ids for r in got)
        print(f"{name}: {time.time() - start:.1f} s, {n_rows} rows, {n_ids} ids", flush=True)
        return {r.split: r.rows for r in got}

    def checked(name, corpus, params):
        blocks = timed(name, prepare_corpus(corpus, vocab, SPECIALS, params))
        told = {r.split: r for r in corpus_accounts(corpus, params).collect()}
        assert blocks == {s: r.blocks for s, r in told.items() if r.blocks}
        assert all(r.tokens_in == r.blocks * (params.max_seq_length - 1) + r.tokens_dropped for r in told.values())

    timed("encode", encode(texts(as_train), vocab, SPECIALS, ["split"]))
    timed("file order, 8192", prepare_path(spark, path, vocab, SPECIALS, PrepareParams()))
    checked("holdout, 8192", as_train, PrepareParams(n_val=1000, n_test=2000))
    checked("holdout, 128", as_train, PrepareParams(n_val=1000, n_test=2000, max_seq_length=128))
    checked("hot split, batches", by_split, PrepareParams())
    checked("hot split, one stream", by_split, PrepareParams(grouping="global"))


if __name__ == "__main__":
    main()
