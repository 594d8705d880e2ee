"""Parquet sources and sinks."""

from corpusweave.sources.block_store import damaged, read_blocks, read_manifest, write_blocks
from corpusweave.sources.parquet import (
    file_positions,
    read_corpus,
    read_ids,
    read_shard,
    rows_of_shard,
    write_ids,
    write_splits,
)

__all__ = [
    "damaged",
    "file_positions",
    "read_blocks",
    "read_corpus",
    "read_ids",
    "read_manifest",
    "read_shard",
    "rows_of_shard",
    "write_blocks",
    "write_ids",
    "write_splits",
]
