from pyspark.sql import functions as F

from corpusweave.__main__ import main
from corpusweave.operators.vocab import frequency_vocabulary


def test_prepare_job(spark, sf_dir, tmp_path):
    corpus = f"{sf_dir}/documents.parquet"
    vocab, out = str(tmp_path / "vocab"), str(tmp_path / "out")
    frequency_vocabulary(spark.read.parquet(corpus), 500).write.parquet(vocab)
    specials = ["--eos", "1", "--bos", "2", "--unk", "3"]
    main(["prepare", corpus, vocab, out, *specials, "--max-seq-length", "64", "--n-val", "20", "--n-test", "30"])
    got = spark.read.parquet(out)
    assert {r.split for r in got.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert got.where(F.size("input_ids") != 64).count() == 0
    cut = str(tmp_path / "cut")
    main(["prepare", corpus, vocab, cut, *specials, "--max-seq-length", "16", "--n-train", "50", "--truncate"])
    assert spark.read.parquet(cut).count() == 50


def test_freeze_job(spark, tmp_path):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token STRING, id INT")
    vocab.write.parquet(str(tmp_path / "a"))
    vocab.where("id <> 1").write.parquet(str(tmp_path / "b"))
    matrix = spark.range(2).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    matrix.write.parquet(str(tmp_path / "m"))
    main(["freeze-ids", *[str(tmp_path / n) for n in ("a", "b", "m", "ids")]])
    assert [r.id for r in spark.read.parquet(str(tmp_path / "ids")).collect()] == [0]
