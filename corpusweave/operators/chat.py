"""Cleaning of role markers in generated or logged chat text.

Only projections of built-in string functions, so it runs the same on a table and on a
stream. Each step is a column of its own, as one nested expression would fold and search
the text anew wherever it is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.chat import (
    MAX_TAIL_SHARE,
    MIN_TAIL_CHARS,
    drop_continuation_marks,
    drop_first_role,
    last_offset,
    occurs_before,
    text_behind,
)


def strip_role_markers(rows: DataFrame, column: str = "text") -> DataFrame:
    """Chat text reduced to what was said; null and empty text stay as they are.

    Where a model echoes a dialogue, the text behind its last model turn is kept, if "user"
    occurs before that turn and the text is neither a fragment nor nearly the whole.
    Otherwise the first line-leading role marker goes, then leading list and quote marks.
    """
    text, tail = F.col(column), F.col("_tail")
    found = (
        rows.withColumn("_folded", F.lower(text))
        .withColumn("_model", last_offset(F.col("_folded"), "model"))
        .withColumn("_assistant", last_offset(F.col("_folded"), "assistant"))
        .withColumn("_at", F.greatest("_model", "_assistant"))
    )
    role_chars = F.when(F.col("_model") > F.col("_assistant"), len("model")).otherwise(len("assistant"))
    echoed = (F.col("_at") >= 0) & occurs_before(F.col("_folded"), "user", F.col("_at"))
    tails = found.withColumn("_tail", F.when(echoed, text_behind(text, F.col("_at") + role_chars)))
    fits = (F.length(tail) >= MIN_TAIL_CHARS) & (F.length(tail) < F.length(text) * F.lit(MAX_TAIL_SHARE))
    plain = drop_continuation_marks(drop_first_role(text))
    cleaned = F.when(text.isNull() | (text == ""), text).when(fits, tail).otherwise(plain)
    return tails.withColumn(column, cleaned).select(*rows.columns)
