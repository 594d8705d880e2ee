"""Prepared blocks as files in their order, with a manifest.

A store holds the rows of each split in the order of ``pos``, a fixed number of them to a file: block ``n`` lies in file
``n div per_file`` and nowhere else, so a reader that wants a range opens only the files of that range. The
manifest has a row per file: its first and last block, their number, and a digest of all its blocks in order.

Files are written by one shuffle on ``(split, file)`` and a sort inside tasks. A write that was cut off goes on where it
stopped: what lies in the store is digested again, and only files that differ are written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.integers import int_div
from corpusweave.functions.words import required
from corpusweave.session import settled

DATA, MANIFEST = "blocks", "manifest"
FILE = ["split", "file"]


def block_digest(ids: Column) -> Column:
    """``md5`` of the ids as decimals, joined by commas."""
    return F.md5(F.array_join(ids.cast("array<string>"), ",").cast("binary"))


def in_files(blocks: DataFrame, per_file: int) -> DataFrame:
    """Adds ``file``, the number of the file that a block lies in."""
    if per_file < 1:
        raise ValueError("a file holds at least one block")
    return blocks.withColumn("file", int_div(required(F.col("pos"), "pos"), per_file))


def manifest_of(blocks: DataFrame) -> DataFrame:
    """``split, file, first, last, blocks, digest`` of blocks with their files.

    The digest is the ``md5`` of the blocks' digests in order, joined by commas; a list holds one file's blocks.
    """
    each = blocks.select(*FILE, F.struct("pos", block_digest(F.col("input_ids")).alias("digest")).alias("block"))
    listed = F.array_sort(F.collect_list("block"))
    return each.groupBy(*FILE).agg(
        F.min("block.pos").alias("first"),
        F.max("block.pos").alias("last"),
        F.count("*").alias("blocks"),
        F.md5(F.array_join(F.transform(listed, lambda b: b["digest"]), ",").cast("binary")).alias("digest"),
    )


def stored_blocks(spark: SparkSession, path: str, columns: DataFrame) -> DataFrame | None:
    """All that lies in a store, also without a manifest; none where there is no store yet."""
    try:
        return spark.read.schema(columns.schema).parquet(f"{path}/{DATA}")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_blocks(blocks: DataFrame, path: str, per_file: int) -> DataFrame:
    """Writes ``split, pos, input_ids`` and further columns to a store, and gives its manifest.

    Positions should be unique in their split. Where the store has files already, those whose digest is right stay as they are,
    others are written anew, and files that the blocks do not have any more are an error, as the store is another one's.
    The manifest is written last, so a store that has one is whole.
    """
    spark = blocks.sparkSession
    rows = in_files(blocks, per_file)
    # Partition columns are read back last.
    rows = rows.select(*[c for c in rows.columns if c not in FILE], *FILE)
    there = stored_blocks(spark, path, rows)
    missing = rows
    if there is not None:
        wanted = settled(manifest_of(rows))
        have = manifest_of(there)
        if have.join(wanted, FILE, "left_anti").limit(1).count():
            raise ValueError(f"{path} holds blocks of another run")
        left = wanted.join(have.select(*FILE, "digest"), [*FILE, "digest"], "left_anti")
        missing = rows.join(left.select(*FILE), FILE, "left_semi").select(*rows.columns)
    ordered = missing.repartition(*FILE).sortWithinPartitions(*FILE, "pos")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*FILE).parquet(f"{path}/{DATA}")
    written = manifest_of(spark.read.schema(rows.schema).parquet(f"{path}/{DATA}"))
    written.withColumn("per_file", F.lit(per_file)).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "split string, file long, first long, last long, blocks long, digest string, per_file int"
    return spark.read.schema(schema).parquet(f"{path}/{MANIFEST}")


def read_blocks(
    spark: SparkSession, path: str, split: str | None = None, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Blocks of a store, or of one split, or the blocks of numbers ``first`` to ``last``.

    The range becomes a condition on the files' numbers, so other files are not opened.
    """
    head = read_manifest(spark, path).select("per_file").first()
    per_file = head.per_file if head else 1
    raw = spark.read.parquet(f"{path}/{DATA}")
    found = raw.withColumn("split", F.col("split").cast("string")).withColumn("file", F.col("file").cast("long"))
    if split is not None:
        found = found.where(F.col("split") == split)
    if first is not None:
        found = found.where((F.col("file") >= first // per_file) & (F.col("pos") >= first))
    if last is not None:
        found = found.where((F.col("file") <= last // per_file) & (F.col("pos") <= last))
    return found


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Files whose blocks are not what the manifest says: ``split, file``."""
    told = read_manifest(spark, path)
    found = manifest_of(read_blocks(spark, path)).select(*FILE, "digest")
    return told.join(found, [*FILE, "digest"], "left_anti").select(*FILE)
