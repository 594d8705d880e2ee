"""Shuffled places by arithmetic: a keyed permutation of the positions 0 … n-1.

A Feistel network over two digits, ``left`` below ``a`` and ``right`` below ``b``, with ``a * b`` just above ``n``: in turn
one digit moves by a keyed function of the other, which any key makes a permutation of the ``a * b`` numbers. A place
that falls on ``n`` or above is permuted again until it is below (cycle walking), so the places below ``n`` are
permuted among themselves. With ``a`` near the root of ``n`` fewer than ``a`` numbers lie outside, so hardly any row walks.

Where positions are known from the files, a shuffle, a holdout and a limit are then comparisons of one number per
row: nothing is sorted, counted or moved, and positions inside the new splits are known as well.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.integers import int_div
from corpusweave.functions.once import once
from corpusweave.functions.words import required
from corpusweave.operators.splits import TEST, TRAIN, VALIDATION, limit_positions
from corpusweave.params import PrepareParams

ROUNDS = 6
# The keyed function works modulo this prime: no product of two residues leaves 62 bits.
PRIME = (1 << 31) - 1
KEYS_PER_ROUND = 5
# A place is a product of two digits below the prime.
MAX_ROWS = 1 << 60


def round_keys(seed: int, number: int) -> list[int]:
    """28 bits of ``md5('<seed>:<round>:<i>')`` each, the factors odd."""
    drawn = [hashlib.md5(f"{seed}:{number}:{i}".encode()).hexdigest()[:7] for i in range(KEYS_PER_ROUND)]
    return [int(d, 16) | 1 for d in drawn]


def mixed(value: Column, keys: list[int]) -> Column:
    """A keyed polynomial of degree two of a number below 2^31, modulo the prime."""
    k = [F.lit(key).cast("long") for key in keys]
    first = (value * k[0] + k[1]) % PRIME
    return ((first * first + k[2]) % PRIME * k[3] + k[4]) % PRIME


def _rounds(left: Column, right: Column, a: Column, b: Column, seed: int, number: int) -> Column:
    """The place ``left * b + right`` after the rounds from ``number`` on."""
    if number == ROUNDS:
        return left * b + right
    keys = round_keys(seed, number)
    if number % 2 == 0:
        return once((left + mixed(right, keys)) % a, lambda moved: _rounds(moved, right, a, b, seed, number + 1))
    return once((right + mixed(left, keys)) % b, lambda moved: _rounds(left, moved, a, b, seed, number + 1))


def permuted_position(position: Column, rows: Column, seed: int) -> Column:
    """The place of a position in the shuffled order of ``rows`` positions.

    For positions below ``rows``, a permutation of them that depends on the seed and the number of rows alone. A null
    gives null.
    """

    def of_digits(a: Column, b: Column) -> Column:
        def step(place: Column) -> Column:
            return _rounds(int_div(place, b), place % b, a, b, seed, 0)

        def walked(place: Column) -> Column:
            # A walk meets each number outside once at most, and there are a * b - rows of those.
            steps = F.sequence(F.lit(1).cast("long"), F.greatest(a * b - rows, F.lit(1).cast("long")))
            walk = F.aggregate(steps, place, lambda at, _: F.when(at < rows, at).otherwise(step(at)))
            return F.when(place < rows, place).otherwise(walk)

        return once(step(position), walked)

    root = F.greatest(F.ceil(F.sqrt(rows.cast("double"))).cast("long"), F.lit(1).cast("long"))
    return once(root, lambda a: once(int_div(rows + a - 1, a), lambda b: of_digits(a, b)))


def permute_splits(corpus: DataFrame, params: PrepareParams) -> DataFrame:
    """Shuffle, hold out and limit the train split by arithmetic alone.

    Takes ``split, pos, split_rows``, as ``read_corpus`` gives them, and gives them anew. With a holdout, ``train`` takes
    the permuted order: its last ``n_val`` places are the validation split, the ``n_test`` places before them the test
    split, and an older split of such a name is replaced; limits apply after that. Without one the order of the files stays.
    A train split that is not larger than the holdout is an error when the rows are read.
    """
    n_val, n_test = params.n_val or 0, params.n_test or 0
    rows = corpus.withColumn("split", required(F.col("split"), "split"))
    if n_val + n_test == 0:
        return limit_positions(rows, params.n_train, params.n_val, params.n_test)
    replaced = [name for name, n in ((VALIDATION, n_val), (TEST, n_test)) if n]
    size = F.col("split_rows")
    checked = F.when(size > n_val + n_test, size).otherwise(
        F.raise_error(F.concat(F.lit(f"holding out {n_val} + {n_test} of "), size.cast("string"), F.lit(" rows leaves no train split")))
    )
    is_train = F.col("split") == TRAIN
    place = F.when(is_train, permuted_position(F.col("pos"), checked, params.seed)).otherwise(F.col("pos"))
    shuffled = rows.where(~F.col("split").isin(replaced)).withColumn("place", place)
    from_end = size - F.col("place")
    name = F.when(~is_train, F.col("split")).when(from_end <= n_val, VALIDATION)
    part = name.when(from_end <= n_val + n_test, TEST).otherwise(TRAIN)
    parted = shuffled.withColumn("part", part)
    first = F.when(~is_train, 0).when(F.col("part") == VALIDATION, size - n_val)
    first = first.when(F.col("part") == TEST, size - n_val - n_test).otherwise(0)
    count = F.when(~is_train, size).when(F.col("part") == VALIDATION, n_val).when(F.col("part") == TEST, n_test)
    kept = [c for c in corpus.columns if c not in ("split", "pos", "split_rows")]
    placed = parted.select(
        *kept,
        F.col("part").alias("split"),
        (F.col("place") - first).cast("long").alias("pos"),
        count.otherwise(size - n_val - n_test).cast("long").alias("split_rows"),
    )
    return limit_positions(placed, params.n_train, None, None)
