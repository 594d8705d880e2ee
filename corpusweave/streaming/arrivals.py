"""The row-wise operators on a stream of arriving part files.

Encoding, truncation and chat cleaning look at one row at a time, so they hold no
state. Splits, positions and packing need the whole corpus and stay batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusweave.operators.chat import strip_role_markers
from corpusweave.operators.encode import encode, texts
from corpusweave.operators.pack import truncate_documents
from corpusweave.params import Specials


def truncated_arrivals(arriving: DataFrame, vocab: DataFrame, specials: Specials, length: int) -> DataFrame:
    """Encoded and truncated rows of a stream of ``doc_id, text``."""
    return truncate_documents(encode(texts(arriving), vocab, specials, ["doc_id"]), length)


def clean_chat(arriving: DataFrame, text_column: str = "text") -> DataFrame:
    return strip_role_markers(arriving, text_column)


def append_rows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a parquet table, each row once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
