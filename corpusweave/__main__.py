"""Jobs for spark-submit: ``python -m corpusweave prepare|freeze-ids …``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corpusweave.operators.vocab import freeze_ids
from corpusweave.params import PrepareParams, Specials
from corpusweave.plans.prepare import prepare_path
from corpusweave.sources.parquet import write_ids, write_splits


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusweave")
    jobs = top.add_subparsers(dest="job", required=True)

    prepare = jobs.add_parser("prepare", help="split, encode and pack a corpus")
    prepare.add_argument("corpus", help="a .parquet path, or a directory partitioned by split")
    prepare.add_argument("vocabulary", help="parquet table (token, id)")
    prepare.add_argument("output", help="directory to write, partitioned by split")
    for name in ("eos", "bos", "unk"):
        prepare.add_argument(f"--{name}", type=int, required=True)
    prepare.add_argument("--max-seq-length", type=int, default=8192)
    for name in ("--n-train", "--n-val", "--n-test"):
        prepare.add_argument(name, type=int)
    prepare.add_argument("--truncate", action="store_true", help="truncate documents instead of packing them")
    prepare.add_argument("--shards", type=int, default=12)
    prepare.add_argument("--batch-rows", type=int, default=1000)
    prepare.add_argument("--grouping", choices=("batches", "global"), default="batches")
    prepare.add_argument("--seed", type=int, default=42)
    prepare.add_argument("--text-column", default="text")
    prepare.add_argument("--encoding", choices=("lookup", "join"), default="lookup")
    prepare.add_argument("--on-null", choices=("fail", "drop"), default="fail")

    freeze = jobs.add_parser("freeze-ids", help="ids of tokens that two vocabularies share")
    freeze.add_argument("first", help="parquet table (token, id)")
    freeze.add_argument("second", help="parquet table (token, id)")
    freeze.add_argument("matrix", help="parquet table (vec_id, embedding) whose rows bound the ids")
    freeze.add_argument("output")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"corpusweave {args.job}").getOrCreate()
    if args.job == "freeze-ids":
        first, second, matrix = (spark.read.parquet(p) for p in (args.first, args.second, args.matrix))
        write_ids(freeze_ids(first, second, matrix), args.output)
        return
    params = PrepareParams(
        max_seq_length=args.max_seq_length,
        n_train=args.n_train,
        n_val=args.n_val,
        n_test=args.n_test,
        use_packing=not args.truncate,
        shards=args.shards,
        batch_rows=args.batch_rows,
        grouping=args.grouping,
        seed=args.seed,
        text_column=args.text_column,
        on_null=args.on_null,
        encoding=args.encoding,
    )
    specials = Specials(eos=args.eos, bos=args.bos, unk=args.unk)
    vocab = spark.read.parquet(args.vocabulary)
    write_splits(prepare_path(spark, args.corpus, vocab, specials, params), args.output)


if __name__ == "__main__":
    main()
