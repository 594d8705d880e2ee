"""Word splitting on ASCII blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \t\n\r]+"


def words(text: Column) -> Column:
    """Words of a text in order; an empty text has none."""
    return F.array_remove(F.split(text, BLANKS), "")


def required(column: Column, name: str) -> Column:
    """The column itself, failing the job on the first null."""
    return F.when(column.isNull(), F.raise_error(F.lit(f"null value in column {name}"))).otherwise(column)
