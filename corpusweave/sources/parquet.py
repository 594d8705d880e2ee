"""Reading corpora with their row order, and writing prepared tables.

A corpus frame has the columns ``doc_id`` (unique, in corpus order), ``text``,
``split``, ``pos`` (row position in its split) and ``split_rows``. File order is
taken from the parquet row index, so it costs a count per file and no shuffle of
the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# One row of (path, two counts) is about 200 bytes: 200 MB at this many files.
MAX_BROADCAST_FILES = 1_000_000


def is_single_file(path: str) -> bool:
    """A path that is read as one ``train`` split."""
    return path.rstrip("/").endswith((".parquet", ".parquet."))


def read_corpus(spark: SparkSession, path: str, text_column: str = "text", spread_over: int | None = None) -> DataFrame:
    """Read a parquet corpus in file order.

    Texts stay where they are read, unless ``spread_over`` asks for them to be dealt to so many
    partitions, as for a small corpus of few row groups.

    A path that ends in ``.parquet`` is one ``train`` split; any other path is a
    directory partitioned by ``split`` whose splits are kept as delivered. Only the
    text column is read.
    """
    raw = spark.read.parquet(path)
    if is_single_file(path):
        raw = raw.withColumn("split", F.lit("train"))
    elif "split" not in raw.columns:
        raise ValueError(f"{path} is neither a .parquet path nor partitioned by split")
    texts = raw.select(
        F.col("split").cast("string").alias("split"),
        F.col(text_column).alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    few = len(raw.inputFiles()) <= MAX_BROADCAST_FILES
    return file_positions(texts, broadcast_files=few, spread_over=spread_over)


def file_positions(rows: DataFrame, broadcast_files: bool, spread_over: int | None = None) -> DataFrame:
    """Number the rows of files read whole: ``doc_id`` overall, ``pos`` per split.

    Takes ``split``, ``file`` and ``row_index``. Each file's first position is a
    running sum over one row per file; with too many files to broadcast, the plain
    join lets Spark choose.
    """
    files = rows.groupBy("split", "file").agg(F.count("*").alias("file_rows"))
    by_split = W.partitionBy("split").orderBy("file")
    overall = W.orderBy("split", "file")
    starts = files.select(
        F.col("file"),
        (F.sum("file_rows").over(overall) - F.col("file_rows")).alias("first_doc"),
        (F.sum("file_rows").over(by_split) - F.col("file_rows")).alias("first_pos"),
        F.sum("file_rows").over(W.partitionBy("split")).alias("split_rows"),
    )
    if broadcast_files:
        starts = F.broadcast(starts)
    kept = [c for c in rows.columns if c not in ("file", "row_index")]
    if spread_over:
        rows = rows.repartition(spread_over, "file", "row_index")
    return rows.join(starts, "file").select(
        (F.col("first_doc") + F.col("row_index")).alias("doc_id"),
        *kept,
        (F.col("first_pos") + F.col("row_index")).alias("pos"),
        "split_rows",
    )


def read_shard(spark: SparkSession, path: str, file_name: str) -> DataFrame:
    """One part file of a large corpus directory, as the sample to work with."""
    return spark.read.parquet(f"{path.rstrip('/')}/{file_name}")


def rows_of_shard(corpus: DataFrame, file_name: str) -> DataFrame:
    """The rows that a corpus frame, as scanned, took from one part file.

    The filter is on file metadata, so Spark skips the other files.
    """
    return corpus.where(F.col("_metadata.file_name") == file_name)


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").cast("long").alias("id")).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id LONG").parquet(path)


def write_splits(prepared: DataFrame, path: str) -> None:
    """Write prepared rows under ``split=<name>/``."""
    prepared.write.partitionBy("split").parquet(path)
