"""Clusters of vectors around centroids, in integers and in built-in functions only.

Components are ``floor(64 * x)``, so every distance and every centroid is exact and no result depends on the
order in which rows are added up. Centroids are a handful of arrays and stand in the plan as literals:
``zip_with`` and ``aggregate`` give the distance to each of them, ``array_min`` over structs of distance and number
chooses the nearest one, and one sum per component and cluster, in generated code, gives the next centroids.

Plan: each round is one scan of the vectors and one aggregate with a row per cluster, combined before it moves, so a
cluster that holds most rows costs no more than any other. No vector moves. Last, the assignment itself, three numbers a row, is
stored and read twice: for the sums per cluster and for the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.arrays import let
from corpusweave.llm.common import stored

SCALE = 64
CLUSTERS = 16
ROUNDS = 3

Centroid = tuple[int, ...]


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and none of its entries is null, infinite or not a number."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)
    )


def kept_vectors(table: DataFrame, dimension: int, key: str, vector: str) -> DataFrame:
    """``key, x``: the quantised vectors of exactly this many components, all of them finite."""
    whole = (F.size(vector) == dimension) & is_finite(F.col(vector))
    return table.where(whole).select(F.col(key).cast("long").alias("key"), quantised(F.col(vector)).alias("x"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> list[Centroid]:
    """The vectors whose ids hash lowest, in the order of the hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    lowest = rows.select(F.sha2(name, 256).alias("hash"), "x").orderBy("hash", "x").limit(clusters)
    return [tuple(r["x"]) for r in lowest.orderBy("hash", "x").collect()]


def longs(values: Sequence[int]) -> str:
    """An array literal, as SQL text: one expression, however many numbers."""
    return f"array({', '.join(f'{v}L' for v in values)})"


def centroid_arrays(centroids: list[Centroid]) -> Column:
    return F.expr(f"array({', '.join(map(longs, centroids))})")


def nearest(x: Column, centroids: list[Centroid]) -> Column:
    """Struct of the least squared distance and the least number of a centroid that has it."""
    zero = F.lit(0).cast("long")

    def choices(v: Column) -> Column:
        def choice(centroid: Column, number: Column) -> Column:
            squares = F.zip_with(v, centroid, lambda a, b: (a - b) * (a - b))
            distance = F.aggregate(squares, zero, lambda total, square: total + square)
            return F.struct(distance.alias("distance"), number.alias("cluster"))

        return F.array_min(F.transform(centroid_arrays(centroids), choice))

    return let(x, choices)


def assigned(rows: DataFrame, centroids: list[Centroid]) -> DataFrame:
    """Adds ``cluster`` and the squared ``distance`` to its centroid."""
    found = rows.withColumn("nearest", nearest(F.col("x"), centroids))
    return found.select(*rows.columns, "nearest.cluster", "nearest.distance")


def moved(rows: DataFrame, centroids: list[Centroid]) -> list[Centroid]:
    """The floored means of the vectors of each cluster; a cluster without vectors keeps its centroid."""
    dimension = len(centroids[0])
    sums = [F.sum(F.get("x", i)).alias(f"sum{i}") for i in range(dimension)]
    means = assigned(rows, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    now = list(centroids)
    for row in means:
        now[row["cluster"]] = tuple(row[f"sum{i}"] // row["n"] for i in range(dimension))
    return now


def fit_centroids(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1) -> list[Centroid]:
    """Centroids after this many rounds; fewer than ``clusters`` where there are fewer vectors."""
    centroids = first_centroids(rows, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    return centroids


def cluster_vectors(
    table: DataFrame,
    dimension: int = 64,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = 1,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid`` of each kept vector.

    Vectors that are null, of another length, or hold null or non-finite entries are left out; repeated rows and
    repeated ids count each, also among the first centroids, where equal hashes stand in the order of their vectors; a
    null id hashes as empty text. Other columns are not read, and no column of the table clashes with those of the
    result. An empty table gives no rows. A squared distance or a sum beyond BIGINT is an error, never a wrong number.
    """
    rows = kept_vectors(table, dimension, key, vector)
    centroids = fit_centroids(rows, clusters, rounds, seed)
    if not centroids:
        kind = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        return table.sparkSession.createDataFrame([], kind)
    placed = stored(assigned(rows, centroids).drop("x"), "clusters")
    sums = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    totals = F.expr(longs([sums.get(i, 0) for i in range(len(centroids))]))
    return placed.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        F.get(totals, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.get(centroid_arrays(centroids), F.col("cluster")).alias("centroid"),
    )
