"""A look at the first rows of a split, without moving the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preview(
    rows: DataFrame, order_by: str | list[str], max_rows: int = 20, max_width: int | None = 20
) -> DataFrame:
    """The first rows as text, each cell and each heading cut; null shows empty."""
    order = [order_by] if isinstance(order_by, str) else order_by
    cells = []
    for name in rows.columns:
        cell = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if max_width is not None and max_width > 0:
            cells.append(F.substring(cell, 1, max_width).alias(name[:max_width]))
        else:
            cells.append(cell.alias(name))
    return rows.orderBy(*order).limit(max_rows).select(*cells)
