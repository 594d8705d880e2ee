"""Packing as a table function: groups are fed to it in order and streamed out.

``pack_batches`` builds blocks from offsets in built-in functions and is the form to use. This one is for
work on packed blocks that built-in functions do not express: a Spark UDTF whose ``analyze`` names
its schema and asks for partitions and their order, so that Spark shuffles and sorts, and the function sees one row after
another and holds less than one block between two of them, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from corpusweave.operators.pack import GROUP, check_block_length

PACKED = StructType().add("split", StringType())
for _name in ("shard", "batch", "block"):
    PACKED.add(_name, LongType())
for _name in ("input_ids", "attention_mask"):
    PACKED.add(_name, ArrayType(IntegerType()))


def block_packer(group: list[str], schema: StructType) -> type:
    """The handler class of the table function; self-contained, so that executors need no copy of this package."""

    class PackBlocks:
        def __init__(self):
            self.pending, self.block, self.key = [], 0, None

        @staticmethod
        def analyze(rows: AnalyzeArgument, length: AnalyzeArgument, bos: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("pack_blocks takes a table")
            lacking = {*group, "pos", "input_ids"} - set(rows.dataType.names)
            if lacking:
                raise ValueError(f"pack_blocks needs the columns {sorted(lacking)}")
            return AnalyzeResult(
                schema,
                partitionBy=[PartitioningColumn(name) for name in group],
                orderBy=[OrderingColumn("pos")],
            )

        def eval(self, rows, length: int, bos: int):
            self.key = [rows[name] for name in group]
            self.pending += rows["input_ids"]
            chunk, at = length - 1, 0
            while at + chunk <= len(self.pending):
                yield *self.key, self.block, [bos, *self.pending[at : at + chunk]], [1] * length
                self.block, at = self.block + 1, at + chunk
            del self.pending[:at]

    return PackBlocks


def pack_streamed(placed: DataFrame, length: int, bos: int) -> DataFrame:
    """Blocks of each ``split, shard, batch`` of documents with ``pos`` and ``input_ids``: the rows of ``pack_batches``
    without the position in the split. What is left over at the end of a group is dropped."""
    check_block_length(length)
    pack = F.udtf(block_packer(GROUP, PACKED))
    rows = placed.select(*[F.col(c).cast("long") if c != "split" else F.col(c) for c in GROUP], "pos", "input_ids")
    return pack(rows.asTable(), F.lit(length), F.lit(bos))
