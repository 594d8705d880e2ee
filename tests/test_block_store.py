import pytest
from pyspark.sql import functions as F

from corpusweave.sources import damaged, read_blocks, read_manifest, write_blocks


def blocks(spark, n=50):
    rows = [("train", i, [i, 2 * i]) for i in range(n)] + [("test", i, [-i]) for i in range(7)]
    return spark.createDataFrame(rows, "split string, pos long, input_ids array<int>").repartition(5)


def listed(rows):
    return sorted((r.split, r.pos, list(r.input_ids)) for r in rows.collect())


def test_round_trip_in_files_of_one_size(spark, tmp_path):
    path = f"{tmp_path}/store"
    manifest = write_blocks(blocks(spark), path, 16)
    files = sorted((r.split, r.file, r["first"], r["last"], r.blocks, r.per_file) for r in manifest.collect())
    assert files == [
        ("test", 0, 0, 6, 7, 16),
        ("train", 0, 0, 15, 16, 16),
        ("train", 1, 16, 31, 16, 16),
        ("train", 2, 32, 47, 16, 16),
        ("train", 3, 48, 49, 2, 16),
    ]
    assert listed(read_blocks(spark, path)) == listed(blocks(spark))
    parts = [p for p in (tmp_path / "store" / "blocks").rglob("*.parquet")]
    assert len(parts) == 5 and not damaged(spark, path).collect()
    for part in parts:  # rows lie in order
        assert [r.pos for r in spark.read.parquet(str(part)).collect()] == sorted(r.pos for r in spark.read.parquet(str(part)).collect())


def test_a_range_opens_its_files_only(spark, tmp_path):
    path = f"{tmp_path}/store"
    write_blocks(blocks(spark), path, 16)
    some = read_blocks(spark, path, "train", 14, 17)
    assert sorted(r.pos for r in some.collect()) == [14, 15, 16, 17]
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "PushedFilters" in text
    scans = some.select(F.col("_metadata.file_path")).distinct().count()
    assert scans == 2
    assert [r.pos for r in read_blocks(spark, path, "test", last=0).collect()] == [0]


def test_a_write_goes_on_where_it_stopped(spark, tmp_path):
    path = f"{tmp_path}/store"
    whole = blocks(spark)
    write_blocks(whole.where("pos < 32"), path, 16)
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "blocks").rglob("*.parquet")}
    write_blocks(whole, path, 16)
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "blocks").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) == len(before) + 2
    assert listed(read_blocks(spark, path)) == listed(whole)


def test_damaged_files_are_found_and_written_anew(spark, tmp_path):
    path = f"{tmp_path}/store"
    whole = blocks(spark)
    write_blocks(whole, path, 16)
    other = whole.where("split = 'train' and pos between 16 and 30")
    other.drop("split", "pos").withColumn("pos", F.lit(20).cast("long")).write.mode("overwrite").parquet(f"{path}/blocks/split=train/file=1")
    assert [tuple(r) for r in damaged(spark, path).collect()] == [("train", 1)]
    write_blocks(whole, path, 16)
    assert not damaged(spark, path).collect() and listed(read_blocks(spark, path)) == listed(whole)


def test_blocks_of_another_run_are_refused(spark, tmp_path):
    path = f"{tmp_path}/store"
    write_blocks(blocks(spark), path, 16)
    with pytest.raises(ValueError, match="another run"):
        write_blocks(blocks(spark).where("pos < 16"), path, 16)


def test_no_blocks(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert write_blocks(blocks(spark).where("false"), path, 4).collect() == []
    assert read_manifest(spark, path).collect() == []


def test_nulls_and_empty_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="at least one"):
        write_blocks(blocks(spark), f"{tmp_path}/a", 0)
    with pytest.raises(Exception, match="null value in column pos"):
        write_blocks(blocks(spark).withColumn("pos", F.lit(None).cast("long")), f"{tmp_path}/b", 4)
