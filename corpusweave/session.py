"""Spark session with the settings this package is measured with."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

MAX_BUCKETS = 100_000


def local_session(cpus: int | str = 8, memory: str = "12g", app: str = "corpusweave") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that all executors share.

    That is the folder set with ``setCheckpointDir`` or named in ``spark.checkpoint.dir``. Without
    either, a local session takes a temporary folder that goes with the process; on a cluster it is an
    error, as executors do not see each other's disks.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="corpusweave-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def bucketed(blocks: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The blocks written once to the shared folder, in as many buckets of ``key`` as there are shuffle partitions."""
    spark = blocks.sparkSession
    buckets = min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"text_blocks_{uuid.uuid4().hex}"
    writer = blocks.write.format("parquet").option("compression", "zstd").option("path", shared_folder(spark, "blocks"))
    writer.bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame knows them
    return table, buckets


def settled(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder, so that later uses do not compute them again."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return rows.checkpoint()
