"""Column helpers for arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where it is used inside of lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(sizes: Column) -> Column:
    """Sums of all earlier elements, by one pass that grows an array."""
    zero = F.array(F.lit(0).cast("long"))
    ends = F.aggregate(sizes, zero, lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
    return F.slice(ends, 1, F.size(sizes))


def running_starts(sizes: Column) -> Column:
    """Sums of all earlier elements of an array; ``BLOCK`` at a time, as growing copies the array."""

    def in_blocks(all_sizes: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(all_sizes) / BLOCK).cast("int") - 1)
        blocks = F.transform(numbers, lambda b: F.slice(all_sizes, b * BLOCK + 1, BLOCK))
        return let(blocks, shifted)

    def shifted(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x))
        firsts = let(totals, _running)
        pairs = F.zip_with(blocks, firsts, lambda s, f: F.struct(s.alias("sizes"), f.alias("first")))
        return F.flatten(F.transform(pairs, lambda b: F.transform(_running(b["sizes"]), lambda s: s + b["first"])))

    return let(sizes, lambda s: F.when(F.size(s) > BLOCK, in_blocks(s)).otherwise(_running(s)))
