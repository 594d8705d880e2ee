"""Column functions over token id arrays and float vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from corpusweave.params import IGNORE_LABEL


def ones(ids: Column) -> Column:
    """Attention mask of an unpadded sequence."""
    return F.array_repeat(F.lit(1), F.size(ids))


def append_id(ids: Column, token_id: int) -> Column:
    return F.concat(ids, F.array(F.lit(token_id)))


def prepend_id(ids: Column, token_id: int) -> Column:
    return F.concat(F.array(F.lit(token_id)), ids)


def truncate(ids: Column, length: int) -> Column:
    """The first ``length`` entries."""
    return F.slice(ids, 1, length)


def pad_left(ids: Column, width: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), width - F.size(ids)), ids)


def pad_right(ids: Column, width: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), width - F.size(ids)))


def labels_of(ids: Column, pad: int) -> Column:
    """Ids as labels; every pad id, wherever it stands, is ignored by the loss."""
    return F.transform(ids, lambda i: F.when(i == pad, IGNORE_LABEL).otherwise(i))


def cross_entropy(logits: Column, label: Column) -> Column:
    """``-log softmax(logits)[label]`` in double, a batch of rows at a time.

    A label outside the logits fails the job, as it is a data error.
    """

    @F.arrow_udf("double")
    def losses(rows: pa.Array, labels: pa.Array) -> pa.Array:
        offsets = rows.offsets.to_numpy()
        values = rows.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
        starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        chosen = labels.to_numpy(zero_copy_only=False).astype(np.int64)
        if ((chosen < 0) | (chosen >= sizes)).any():
            raise ValueError("label outside the vocabulary")
        if not len(starts):
            return pa.array([], pa.float64())
        with np.errstate(invalid="ignore", over="ignore"):
            top = np.maximum.reduceat(values, starts)
            total = np.add.reduceat(np.exp(values - np.repeat(top, sizes)), starts)
            return pa.array(top + np.log(total) - values[starts + chosen])

    return losses(logits, label)


def l1_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, z: acc + F.abs(z.cast("double")))


def zeros_like(vector: Column, element: DataType) -> Column:
    return F.array_repeat(F.lit(0).cast(element), F.size(vector))
