import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from corpusweave.operators.preview import preview
from corpusweave.session import shared_folder
from corpusweave.sources.parquet import (
    file_positions,
    read_corpus,
    read_ids,
    read_shard,
    rows_of_shard,
    write_ids,
    write_splits,
)

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """A corpus directory of four part files, whose row order is the word number."""
    path = str(tmp_path_factory.mktemp("corpus") / "whole.parquet")
    body, other = F.concat(F.lit("w"), F.col("id")).alias("body"), (F.col("id") * 2).alias("other")
    rows = spark.range(0, 1000, 1, 4).select(body, other)
    rows.write.option("parquet.block.size", 2048).parquet(path)
    return path


def test_file_order_gives_positions(spark, shards):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        corpus = read_corpus(spark, shards, "body")
        got = corpus.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.pos, r.doc_id, r.text) for r in got) == [(i, i, f"w{i}") for i in range(1000)]
    assert {(r.split, r.split_rows) for r in got} == {("train", 1000)}


def test_many_files_take_the_plain_join(spark, shards):
    raw = spark.read.parquet(shards).select(
        F.lit("train").alias("split"),
        F.col("body").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    got = file_positions(raw, broadcast_files=False).collect()
    assert sorted((r.pos, r.text) for r in got) == [(i, f"w{i}") for i in range(1000)]


def test_texts_stay_where_they_are_read_unless_asked(spark, shards):
    plan = read_corpus(spark, shards, "body")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan
    spread = read_corpus(spark, shards, "body", spread_over=3)
    assert "REPARTITION_BY_NUM" in spread._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, read_corpus(spark, shards, "body").collect()))


def test_only_the_text_is_read(spark, shards):
    plan = read_corpus(spark, shards, "body")._jdf.queryExecution().executedPlan().toString()
    assert "body" in plan and "other" not in plan


def test_splits_are_kept_as_delivered(spark, tmp_path):
    rows = spark.range(10).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
        F.when(F.col("id") < 7, "train").otherwise("dev").alias("split"),
    )
    write_splits(rows.coalesce(1), str(tmp_path / "out"))
    back = read_corpus(spark, str(tmp_path / "out"))
    assert back.select("doc_id").distinct().count() == 10
    assert {(r.split, r.split_rows) for r in back.collect()} == {("train", 7), ("dev", 3)}
    got = sorted((r.split, r.pos, r.text) for r in back.collect())
    assert got == [("dev", p, f"t{7 + p}") for p in range(3)] + [("train", p, f"t{p}") for p in range(7)]


def test_a_directory_without_splits_is_refused(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="partitioned by split"):
        read_corpus(spark, str(tmp_path / "plain"), "id")


def test_a_missing_path_fails(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_corpus(spark, "/nowhere/at/all.parquet")


def test_one_shard(spark, shards):
    whole = spark.read.parquet(shards)
    names = [r[0] for r in whole.select("_metadata.file_name").distinct().orderBy("file_name").collect()]
    assert len(names) == 4
    for i, name in enumerate(names):
        want = {f"w{n}" for n in range(250 * i, 250 * i + 250)}
        assert {r.body for r in rows_of_shard(whole, name).collect()} == want
        assert {r.body for r in read_shard(spark, shards, name).collect()} == want
        assert rows_of_shard(whole, name).rdd.getNumPartitions() == 1 < whole.rdd.getNumPartitions()


def test_id_lists(spark, tmp_path):
    write_ids(spark.createDataFrame([(3,), (1,)], "id INT"), str(tmp_path / "ids"))
    back = read_ids(spark, str(tmp_path / "ids"))
    assert back.schema.simpleString() == "struct<id:bigint>"
    assert sorted(r.id for r in back.collect()) == [1, 3]


class Cluster:
    """What ``shared_folder`` asks of a session."""

    def __init__(self, master, folder=None, setting=None):
        context = type("Context", (), {"master": master, "getCheckpointDir": lambda _: folder})()
        self.sparkContext = context
        self.conf = type("Conf", (), {"get": lambda _, key, default: setting or default})()


def test_shared_folder_follows_the_session(spark):
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first != second
    assert shared_folder(Cluster("yarn", setting="s3a://bucket/work/"), "x").startswith("s3a://bucket/work/x-")
    assert shared_folder(Cluster("yarn", folder="hdfs:/set", setting="s3a://bucket"), "x").startswith("hdfs:/set/x-")


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_no_folder_of_one_machine_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(master), "x")


def test_the_local_folder_goes_with_the_process():
    code = "import os; from corpusweave.session import _local_folder as f; open(os.path.join(f(), 'a'), 'w').close(); print(f())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert "corpusweave-" in done.stdout and not os.path.exists(done.stdout.strip())


def test_preview(spark):
    rows = spark.createDataFrame(
        [(2, None, "x" * 50), (1, 1.5, "short"), (3, 0.0, "")], "n INT, a_long_column_name_here DOUBLE, t STRING"
    )
    got = preview(rows, "n", max_rows=2, max_width=10)
    assert got.columns == ["n", "a_long_col", "t"]
    assert [tuple(r) for r in got.collect()] == [("1", "1.5", "short"), ("2", "", "x" * 10)]
    assert [r.n for r in preview(rows, ["t", "n"], max_rows=3).collect()] == ["3", "1", "2"]
    assert preview(rows, "n", max_width=None).collect()[1].t == "x" * 50
