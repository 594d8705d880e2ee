"""Zeroing and measuring rows of a matrix table ``(vec_id, embedding)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.exact import exact_sums
from corpusweave.functions.sequences import l1_norm, zeros_like


def _flagged(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    hits = ids.select(F.col("id").cast("long").alias("vec_id")).distinct().withColumn("hit", F.lit(True))
    return matrix.join(hits, "vec_id", "left")  # an outer join cannot broadcast the side it keeps


def zero_rows(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """The matrix with the rows of the given ids set to zero."""
    vector = F.col("embedding")
    element = matrix.schema["embedding"].dataType.elementType
    kept = F.when(F.col("hit"), zeros_like(vector, element)).otherwise(vector)
    return _flagged(matrix, ids).withColumn("embedding", kept).select(*matrix.columns)


def zero_input_and_output(
    inputs: DataFrame, outputs: DataFrame | None, ids: DataFrame, include_output: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Both embedding matrices of a model; the output one only by flag."""
    masked = zero_rows(outputs, ids) if include_output and outputs is not None else outputs
    return zero_rows(inputs, ids), masked


def row_norms(matrix: DataFrame) -> DataFrame:
    return matrix.select("vec_id", l1_norm(F.col("embedding")).alias("l1"))


def l1_totals(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """L1 of the whole matrix and of the given rows; the latter is 0 once zeroed."""
    norms = _flagged(matrix, ids).select(l1_norm(F.col("embedding")).alias("l1"), "hit")
    return norms.agg(
        F.coalesce(F.sum("l1"), F.lit(0.0)).alias("total_l1"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("l1"))), F.lit(0.0)).alias("frozen_l1"),
    )


def l1_exact(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """The same from exact sums over rows: bit for bit equal however the matrix is partitioned."""
    norms = _flagged(matrix, ids).select(l1_norm(F.col("embedding")).alias("l1"), "hit")
    frozen = F.when(F.col("hit"), F.col("l1"))
    return exact_sums(norms, [], total_l1=F.col("l1"), frozen_l1=frozen).select("total_l1", "frozen_l1")
