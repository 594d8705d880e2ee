"""Sums of doubles that do not depend on the order of the rows.

A double is cut into digits of ``BITS`` bits at fixed places, each an integer; digits of a place are added up as decimals, which
is exact, and the digits of the sum, after carrying, are the same whatever the order and the partitions. They are
put together as a double once, from the smallest. What lies below ``2^-LOWEST`` of a single value is cut off, far below what
a double sum would keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.once import once

BITS = 40
# Digits at 2^120, 2^80, 2^40, 1, 2^-40, 2^-80, 2^-120: every float and doubles up to 2^160.
PLACES = range(3, -4, -1)
LOWEST = BITS * -min(PLACES)
LARGEST = float(1 << (BITS * (max(PLACES) + 1)))
SUM = "decimal(38,0)"


def digits(value: Column) -> list[Column]:
    """The digits of a finite double, the highest place first, all with the value's sign.

    Scaling by a power of two, taking the whole part and the difference of two of those are exact. A value of
    ``2^160`` and more is an error.
    """
    known = F.when(F.abs(value) < LARGEST, value).otherwise(
        F.when(value.isNotNull(), F.raise_error(F.lit("a value is too large for an exact sum")))
    )

    def whole(place: int) -> Column:
        scaled = known * F.lit(2.0 ** (-BITS * place))
        return scaled - scaled % 1

    return [(whole(p) - whole(p + 1) * F.lit(2.0**BITS)).cast("long") for p in PLACES]


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def digit_sums(value: Column) -> list[Column]:
    """Aggregates that ``sum_of`` takes; nulls are left out, what is not finite counts apart."""
    finite = F.when(is_finite(value), value)
    apart = [F.count_if(F.isnan(value)), F.count_if(value == float("inf")), F.count_if(value == float("-inf"))]
    return [F.sum(d.cast(SUM)).cast(SUM) for d in digits(finite)] + apart


def carried(sums: list[Column]) -> Column:
    """Struct of the digits of the sum, the lowest first, each below ``2^BITS`` and not negative, and the last carry."""
    base = F.lit(1 << BITS).cast(SUM)
    lowest_first = F.array(*[F.coalesce(s.cast(SUM), F.lit(0).cast(SUM)) for s in reversed(sums)])
    start = F.struct(F.lit(0).cast(SUM).alias("carry"), F.array().cast(f"array<{SUM}>").alias("digits"))

    def add(state: Column, digit: Column) -> Column:
        whole = (digit + state["carry"]).cast(SUM)
        kept = F.pmod(whole, base).cast(SUM)
        carry = F.call_function("div", (whole - kept).cast(SUM), base).cast(SUM)
        return F.struct(carry.alias("carry"), F.concat(state["digits"], F.array(kept)).alias("digits"))

    return F.aggregate(lowest_first, start, add)


def _together(sums: list[Column]) -> Column:
    """The sum as a double, put together from the smallest digit; null where it is negative."""
    scales = F.array(*[F.lit(2.0 ** (BITS * p)) for p in range(min(PLACES), max(PLACES) + 2)])

    def value(found: Column) -> Column:
        places = F.concat(found["digits"], F.array(found["carry"]))
        terms = F.zip_with(places, scales, lambda digit, scale: digit.cast("double") * scale)
        total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
        return F.when(found["carry"] >= 0, total)

    return once(carried(sums), value)


def sum_of(sums: list[Column]) -> Column:
    """The sum as a double, from the columns of ``digit_sums``; zero where there were no values.

    Not a number where a value was none, or where infinities of both signs met.
    """
    *places, nans, above, below = sums
    total = F.coalesce(_together(places), -_together([-p for p in places]))
    infinite = F.when(above > 0, float("inf")).when(below > 0, float("-inf")).otherwise(total)
    return F.when((nans > 0) | ((above > 0) & (below > 0)), float("nan")).otherwise(infinite)


def exact_sums(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """``keys``, the named sums, and ``n_<name>``, how many values are not null."""
    parts = {name: digit_sums(value.cast("double")) for name, value in values.items()}
    columns = [c.alias(f"{name}_{i}") for name, sums in parts.items() for i, c in enumerate(sums)]
    counts = [F.count(value).alias(f"n_{name}") for name, value in values.items()]
    found = rows.groupBy(*keys).agg(*columns, *counts)
    sums = [sum_of([F.col(f"{name}_{i}") for i in range(len(parts[name]))]).alias(name) for name in values]
    return found.select(*keys, *sums, *[f"n_{name}" for name in values])
