"""Integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Whole quotient as BIGINT, exact where a double quotient would round."""
    return F.call_function("div", a.cast("long"), b.cast("long") if isinstance(b, Column) else F.lit(b).cast("long"))
