import hashlib

import numpy as np
import pytest
from cases import VECTORS, kept_vectors, odd_vectors
from pyspark.sql import functions as F

from corpusweave.llm.centroids import cluster_vectors


def plain(rows, clusters=16, rounds=3):
    """Centroids and assignments by a plain loop over Python's integers."""
    xs = [tuple(int(np.floor(64 * float(np.float32(v)))) for v in r[1]) for r in rows]
    names = [hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in rows]
    centroids = [x for _, x in sorted(zip(names, xs))[:clusters]]

    def assign():
        found = []
        for x in xs:
            found.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids)))
        return found

    for _ in range(rounds):
        members = {}
        for x, (_, i) in zip(xs, assign()):
            members.setdefault(i, []).append(x)
        for i, own in members.items():
            centroids[i] = tuple(sum(column) // len(own) for column in zip(*own))
    return centroids, assign()


def test_equals_a_plain_loop(spark):
    rows = kept_vectors()
    centroids, assigned = plain(rows)
    sums = {}
    for d, i in assigned:
        sums[i] = sums.get(i, 0) + d
    want = [(r[0], i, d, sums[i], sum(sums.values()), list(centroids[i])) for r, (d, i) in zip(rows, assigned)]
    table = spark.createDataFrame(odd_vectors(), VECTORS).repartition(5)
    clashing = table.select("*", *[F.lit("x").alias(c) for c in ("x", "key", "cluster", "distance", "centroid", "nearest", "hash")])
    for given in (table, clashing):
        got = [tuple(r) for r in cluster_vectors(given).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [1.0] * 3)]])
def test_no_vectors_give_no_rows(spark, vectors):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    result = cluster_vectors(table)
    assert result.collect() == []
    assert result.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_fewer_vectors_than_clusters_and_empty_clusters(spark):
    table = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = cluster_vectors(table, dimension=2).collect()
    assert len(rows) == 5 and {r["distance"] for r in rows} == {0} and len({r["cluster"] for r in rows}) == 2


def test_no_vector_moves_and_no_python_runs(spark):
    table = spark.createDataFrame(odd_vectors(), VECTORS)
    text = cluster_vectors(table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_too_large_entries_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="overflow"):
        cluster_vectors(table, dimension=2).collect()
