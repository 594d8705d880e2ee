"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred rows.

With ``X`` the centred rows, the process builds right vectors ``v`` and left vectors ``u`` in turn::

    alpha_j u_j = X v_j - beta_(j-1) u_(j-1)          beta_j v_(j+1) = X' u_j - alpha_j v_j

each made orthogonal to all earlier ones of its kind, so that ``X V = U B`` with ``B`` upper bidiagonal. The SVD
of the small ``B`` gives the components, ``V`` times its right vectors, and the deviations, its singular values
over the root of the number of rows. A left vector is as long as the table and is never stored: it is a product
``u = X w`` and known by the few numbers ``w``. One pass over the rows therefore gives all that a step needs:
the norm of ``X w``, its products with all earlier left vectors, and ``X' (X w)``.

Plan: rows are quantised once and stored as dense blocks of integers in the shared folder. A pass is a scan of the blocks, a
product per block in numpy, and an aggregate of one row per number; only such sums reach the driver, the
square of the dimension at most. Rows that are lost with an executor are read again from the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import released, shipped, stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BLOCK_NUMBERS = 1 << 18
# Quantised entries stay below this, so that sums over 2^23 of them and squares of single ones fit 64 bits.
LARGEST = 1 << 40
NOTHING = 1e-12


def vector_blocks(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``dimension, keys, entries``: vectors of one length, ``floor(64 * c)`` as 64-bit integers row after row.

    Vectors that are null or hold null or non-finite entries are left out.
    """
    rows = table.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    names = ["dimension", "keys", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes >= 0]).tolist():
                mine = pa.array(sizes == size)
                keys = batch.column(0).filter(mine)
                values = lists.filter(mine).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), size)
                whole = np.isfinite(values).all(axis=1)  # a null entry is read as not a number
                numbers = np.floor(SCALE * values[whole])
                if (np.abs(numbers) >= LARGEST).any():
                    raise ValueError(f"an entry is too large: {np.abs(numbers).max() / SCALE}")
                entries, keys = numbers.astype(np.int64), keys.filter(pa.array(whole))
                step = max(1, BLOCK_NUMBERS // max(1, size))
                for first in range(0, len(keys), step):
                    part = keys.slice(first, step)
                    kept = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
                    data = pa.array([entries[first : first + step].tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), kept, data], names)

    shipped(table.sparkSession)
    return rows.mapInArrow(lambda batches: released(run(batches)), "dimension int, keys array<long>, entries binary")


def matrix(entries: bytes, dimension: int) -> np.ndarray:
    return np.frombuffer(entries, np.int64).reshape(-1, dimension)


def summed(blocks: DataFrame, dimension: int, sums: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """The sum over all blocks of the flat array that ``sums`` gives for the rows of one.

    One pass. A task gives one row per number, which are added up by Spark: exactly, or as doubles.
    """
    kind = "long" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for entries in batch.column(0):
                found = sums(matrix(entries.as_buffer(), dimension))
                total = found if total is None else total + found
        if total is not None:
            columns = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "value"])

    parts = blocks.select("entries").mapInArrow(run, f"i int, value {kind}")
    value = F.sum(F.col("value").cast("decimal(38,0)")) if exact else F.sum("value")
    found = sorted((r["i"], r["value"]) for r in parts.groupBy("i").agg(value.alias("value")).collect())
    return np.array([int(v) if exact else v for _, v in found], object if exact else np.float64)


@dataclass(frozen=True)
class Centre:
    """Row count, exact sums per dimension of the entries plus ``OFFSET``, and the mean in two parts.

    ``whole`` is the integer below the mean of the stored entries, ``rest`` what is left of it, below one: entries
    less ``whole`` are exact, and so is ``rest`` to double precision however far from zero the mean lies.
    """

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n - OFFSET for s in self.sums], np.int64)

    @property
    def left(self) -> list[int]:
        """Sums of the entries less ``whole``: from 0 up to ``n``."""
        return [s % self.n for s in self.sums]

    @property
    def rest(self) -> np.ndarray:
        return np.array([s / self.n for s in self.left])

    def products(self, rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Centred rows times vectors."""
        return (rows - self.whole).astype(np.float64) @ vectors - self.rest @ vectors


def centre_of(blocks: DataFrame, dimension: int) -> Centre:
    def sums(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(rows)], rows.sum(axis=0)])

    n, *found = summed(blocks, dimension, sums, exact=True)
    return Centre(n, tuple(s + OFFSET * n for s in found))


@dataclass(frozen=True)
class Step:
    """What one pass gives of ``u = X w``: its products with earlier left vectors, its square, and ``X' u``."""

    earlier: np.ndarray
    square: float
    back: np.ndarray


def one_pass(blocks: DataFrame, centre: Centre, w: np.ndarray, left: list[np.ndarray]) -> Step:
    columns = np.column_stack([*left, w])

    def sums(rows: np.ndarray) -> np.ndarray:
        all_u = centre.products(rows, columns)
        u = all_u[:, -1]
        centred = (rows - centre.whole).astype(np.float64)
        return np.concatenate([all_u.T @ u, centred.T @ u - centre.rest * u.sum()])

    found = summed(blocks, len(w), sums)
    k = len(left)
    return Step(found[:k], float(found[k]), found[k + 1 :])


def orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """A vector less its parts along an orthonormal basis, taken away twice."""
    for _ in range(2 if basis else 0):
        known = np.column_stack(basis)
        vector = vector - known @ (known.T @ vector)
    return vector


def fresh(dimension: int, basis: list[np.ndarray]) -> np.ndarray | None:
    """A unit vector orthogonal to the basis, always the same; none where the basis is complete."""
    if len(basis) >= dimension:
        return None
    start = np.random.default_rng(len(basis)).standard_normal(dimension)
    found = orthogonal(start, basis)
    return found / np.linalg.norm(found)


@dataclass(frozen=True)
class Bidiagonal:
    """Right vectors as columns and the bidiagonal matrix."""

    v: np.ndarray
    b: np.ndarray


def bidiagonalise(blocks: DataFrame, dimension: int, centre: Centre, steps: int | None = None) -> Bidiagonal:
    """As many steps as asked for, or as there are dimensions: then the bidiagonal form is complete.

    Where a step gives nothing new (equal eigenvalues, dependent dimensions) the process goes on from a vector
    orthogonal to all before, so no component is missed.
    """
    steps = dimension if steps is None else min(steps, dimension)
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # the w of each left vector, where there is one
    back: list[np.ndarray] = []  # X' u of each left vector
    b = np.zeros((steps, steps))
    size, v, beta, before = 0.0, fresh(dimension, right), 0.0, None
    for j in range(steps):
        right.append(v)
        w = v if before is None else v - beta * left[before]
        step = one_pass(blocks, centre, w, left)
        drift = step.earlier  # what is left along earlier ones by rounding goes
        square = step.square - float(drift @ drift)
        image = step.back - reduce(np.add, (c * x for c, x in zip(drift, back, strict=True)), np.zeros(dimension))
        alpha = float(np.sqrt(max(square, 0.0)))
        size = max(size, alpha, beta)
        before, beta, onward = None, 0.0, None
        if alpha > NOTHING * size:
            w = w - reduce(np.add, (c * x for c, x in zip(drift, left, strict=True)), np.zeros(dimension))
            left.append(w / alpha)
            back.append(image / alpha)
            b[j, j] = alpha
            before = len(left) - 1
            onward = orthogonal(back[-1] - alpha * v, right)
            beta = float(np.linalg.norm(onward))
            size = max(size, beta)
        if onward is not None and beta > NOTHING * size and j + 1 < dimension:
            v = onward / beta
            if j + 1 < steps:
                b[j, j + 1] = beta
        else:
            before, beta, v = None, 0.0, fresh(dimension, right)
    return Bidiagonal(np.column_stack(right), b)


@dataclass(frozen=True)
class Whitening:
    """Centre, unit components as columns by falling deviation, their variances, and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        return self.centre.products(rows, self.components / np.sqrt(self.variances))


def fit_whitening(blocks: DataFrame, dimension: int, components: int = COMPONENTS, steps: int | None = None) -> Whitening:
    """The leading components; fewer where the rows vary in fewer directions."""
    centre = centre_of(blocks, dimension)
    form = bidiagonalise(blocks, dimension, centre, steps)
    _, deviations, right = np.linalg.svd(form.b)
    kept = deviations[:components]
    kept = kept[kept > NOTHING * max(deviations[0], 1e-300)]
    found = form.v @ right[: len(kept)].T
    found = found / np.linalg.norm(found, axis=0)
    variances = deviations**2 / centre.n

    def squares(rows: np.ndarray) -> np.ndarray:
        centred = (rows - centre.whole).astype(np.float64) - centre.rest
        return np.array([float((centred * centred).sum())])

    trace = float(summed(blocks, dimension, squares)[0]) / centre.n
    return Whitening(centre, found, variances[: len(kept)], trace)


def identity_error(blocks: DataFrame, dimension: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; a pass for their mean, one for squares."""
    n, k = model.centre.n, model.components.shape[1]
    mean = summed(blocks, dimension, lambda rows: model.whitened(rows).sum(axis=0)) / n

    def products(rows: np.ndarray) -> np.ndarray:
        centred = model.whitened(rows) - mean
        return (centred.T @ centred).ravel()

    covariance = summed(blocks, dimension, products).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def deviation(inner: Column, squares: Column, centre: Centre) -> Column:
    """``sum((n * x - S)^2)`` as a decimal, exactly, from a row's squares and its product with the sums.

    With entries ``y`` less the whole part of the mean and sums ``R`` of those, it is
    ``n^2 y.y - 2 n y.R + R.R``; ``inner`` is ``y.R``, ``squares`` is ``y.y``.
    """
    n = Decimal(centre.n)
    rest = Decimal(sum(r * r for r in centre.left))
    square, cross = F.lit(n * n).cast("decimal(26,0)"), F.lit(2 * n).cast("decimal(14,0)")
    first = (squares.cast("decimal(38,0)") * square.cast("decimal(38,0)")).cast("decimal(38,0)")
    second = (inner.cast("decimal(38,0)") * cross.cast("decimal(38,0)")).cast("decimal(38,0)")
    return (first - second + F.lit(rest).cast("decimal(38,0)")).cast("decimal(38,0)")


def whitened_rows(blocks: DataFrame, dimension: int, model: Whitening, key: str = "vec_id") -> DataFrame:
    """``key, squares, inner, whitened``: a row's exact products with itself and the sums, and its whitened components."""
    centre = model.centre
    left = np.array(centre.left, object)
    names = [key, "squares", "inner", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, entries in zip(batch.column(0), batch.column(1), strict=True):
                rows = matrix(entries.as_buffer(), dimension)
                whitened = model.whitened(rows)
                y = (rows - centre.whole).astype(object)  # Python's integers: no sum is too large
                offsets = pa.array(np.arange(len(rows) + 1) * whitened.shape[1], pa.int32())
                columns = [
                    keys.values,
                    pa.array([Decimal(v) for v in (y * y).sum(axis=1)], pa.decimal128(38, 0)),
                    pa.array([Decimal(v) for v in y @ left], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = f"`{key}` long, squares decimal(38,0), inner decimal(38,0), whitened array<double>"
    return blocks.select("keys", "entries").mapInArrow(lambda batches: released(run(batches)), kind)


def whiten(
    table: DataFrame,
    components: int = COMPONENTS,
    steps: int | None = None,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``key, n, deviation, whitened, explained, identity_error`` of each vector, one row a vector.

    ``whitened`` and ``explained`` have an entry per component, by falling variance; ``deviation`` is a decimal.
    Vectors that are null or hold null or non-finite entries are left out. All others should have one length; where they
    do not, those of the most frequent length (of equals: the greatest) are whitened and the others left out.
    Repeated rows count each, a null key stays, other columns are not read. Where rows vary in fewer directions than
    ``components`` there are fewer entries, none for equal rows. No vectors give no rows.
    Fewer ``steps`` than dimensions make the components approximate.
    """
    blocks = stored(vector_blocks(table, key, vector), "vectors")
    kind = f"`{key}` long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    sizes = blocks.groupBy("dimension").agg(F.sum(F.size("keys")).alias("n")).where("dimension > 0").collect()
    if not sizes:
        return table.sparkSession.createDataFrame([], kind)
    dimension = max((r["n"], r["dimension"]) for r in sizes)[1]
    mine = blocks.where(F.col("dimension") == dimension)
    model = fit_whitening(mine, dimension, components, steps)
    some = model.components.shape[1] > 0
    error = identity_error(mine, dimension, model) if some else 0.0
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.variances]).cast("array<double>")
    return whitened_rows(mine, dimension, model, key).select(
        key,
        F.lit(model.centre.n).cast("long").alias("n"),
        deviation(F.col("inner"), F.col("squares"), model.centre).alias("deviation"),
        "whitened",
        explained.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
