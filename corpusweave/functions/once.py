"""Values that are worked out once and used several times inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value as a variable: an expression does not grow with the number of its uses."""
    return F.get(F.transform(F.array(value), use), 0)
