"""What the operators share: input columns, word pattern, digests, folders for intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.session import bucketed, settled, shared_folder

__all__ = [
    "WORD",
    "block_by_block",
    "bucketed",
    "checkpointed",
    "crc_fold",
    "digest",
    "documents",
    "give_back",
    "new_folder",
    "released",
    "shipped",
    "stored",
    "strings",
    "text_or_empty",
]

_SHIPPED: set[str] = set()

# A word: a run of anything but the six ASCII blanks. ``bytes.split()`` splits on the same six.
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def digest(*columns: Column) -> Column:
    """16 bytes that stand for the values, as a grouping key for long texts."""
    return F.unhex(F.md5(F.concat(*[c.cast("binary") for c in columns])))


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package sent along to the Python workers of its executors.

    Once per application; jobs submitted with ``--py-files`` may do without, and lose nothing by it.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        # The driver's own folder: Spark serves the file to the executors from there.
        archive = Path(tempfile.mkdtemp(prefix="corpusweave-")) / f"{package.name}-{uuid.uuid4().hex[:12]}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, str(Path(package.name) / path.relative_to(package)))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def give_back() -> None:
    """Returns memory that this process keeps for reuse to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library knows how
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches, after which a Python worker gives its memory back.

    Workers stay alive between tasks of one kind, beside those of the next.
    """
    yield from batches
    give_back()


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows in the folder of ``spark.checkpoint.dir``, so that no later use computes them again."""
    return settled(rows)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Like ``checkpointed``, as Parquet: for wide rows, which compress well."""
    folder = new_folder(rows.sparkSession, purpose)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def block_by_block(
    blocks: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *key: str
) -> DataFrame:
    """``run`` over the rows of each key, which lie in buckets of it.

    As ``mapInArrow``, but a batch holds one block, where that fills batches with as many as 64 MB take, of which Spark and
    the worker hold several copies.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from released(run(batches))

    return blocks.groupBy(*key).applyInArrow(one, schema)


def new_folder(spark: SparkSession, purpose: str) -> str:
    return shared_folder(spark, f"{purpose}-{uuid.uuid4().hex[:8]}")


def strings(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """Python strings of a column, null as empty, one at a time."""
    for value in column:
        yield value.as_py() or ""
