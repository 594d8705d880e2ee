import math
import random

import pytest
from pyspark.sql import functions as F

from corpusweave.functions.exact import exact_sums
from corpusweave.operators.matrix import l1_exact
from corpusweave.operators.metrics import perplexity_exact


def doubles(seed, n=400):
    rng = random.Random(seed)
    return [rng.uniform(-1, 1) * 2.0 ** rng.randint(-60, 100) for _ in range(n)] + [0.0, -0.0, 1e30, -1e30]


def summed(spark, values, partitions):
    rows = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double").repartition(partitions)
    return {r.k: (r.s, r.n_s) for r in exact_sums(rows, ["k"], s=F.col("v")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_are_right_and_equal_under_any_partitions(spark, seed):
    values = doubles(seed)
    random.Random(seed).shuffle(values)
    one = summed(spark, values, 1)
    for partitions in (8, 64):
        assert summed(spark, values[::-1][::-1], partitions) == one
    for k in range(3):
        own = values[k::3]
        assert one[k][0] == pytest.approx(math.fsum(own), rel=4e-16, abs=2.0**-119) and one[k][1] == len(own)


@pytest.mark.parametrize(
    "values,want",
    [
        ([1e16, 1.0, -1e16], 1.0),
        ([-0.1], -0.1),
        ([-0.1, -0.2, 0.25], math.fsum([-0.1, -0.2, 0.25])),
        ([2.0**100, 2.0**-60, -(2.0**100)], 2.0**-60),
        ([], 0.0),
        ([None, 3.5], 3.5),
        ([float("inf"), 1.0], float("inf")),
        ([float("-inf"), 1.0], float("-inf")),
    ],
)
def test_cancelling_and_special_values(spark, values, want):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_sums(rows, [], s=F.col("v")).first().s == want


@pytest.mark.parametrize("values", [[float("nan"), 1.0], [float("inf"), float("-inf")]])
def test_no_number(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert math.isnan(exact_sums(rows, [], s=F.col("v")).first().s)


def test_too_large_values_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        exact_sums(spark.createDataFrame([(1e300,)], "v double"), [], s=F.col("v")).collect()


def test_losses_and_norms_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    losses = [(rng.randint(0, 3), rng.expovariate(0.3)) for _ in range(500)]
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    found = set()
    for partitions in (1, 8, 64):
        rows = spark.createDataFrame(losses, "k int, loss double").repartition(partitions)
        matrix = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(partitions)
        ids = spark.range(40)
        by = sorted(tuple(r) for r in perplexity_exact(rows, ["k"]).collect())
        found.add(repr((by, perplexity_exact(rows).first(), l1_exact(matrix, ids).first())))
    assert len(found) == 1
    assert perplexity_exact(spark.createDataFrame([], "loss double")).first().eval_loss == float("inf")
