import pytest
from pyspark.sql import functions as F

from corpusweave import PrepareParams
from corpusweave.operators.permute import MAX_ROWS, PRIME, ROUNDS, permute_splits, permuted_position, round_keys


def plain(n, seed):
    """The permutation by a plain loop over Python's integers."""
    a = max(1, -int(-(n**0.5) // 1))
    b = (n + a - 1) // a

    def once(place):
        x, y = divmod(place, b)
        for r in range(ROUNDS):
            k = round_keys(seed, r)
            moved = y if r % 2 == 0 else x
            first = (moved * k[0] + k[1]) % PRIME
            moved = ((first * first + k[2]) % PRIME * k[3] + k[4]) % PRIME
            x, y = ((x + moved) % a, y) if r % 2 == 0 else (x, (y + moved) % b)
        return x * b + y

    found = []
    for place in range(n):
        place = once(place)
        while place >= n:
            place = once(place)
        found.append(place)
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
@pytest.mark.parametrize("seed", [0, 42])
def test_equals_a_plain_loop_and_is_a_permutation(spark, n, seed):
    rows = spark.range(n).select("id", permuted_position(F.col("id"), F.lit(n).cast("long"), seed).alias("place"))
    got = [r.place for r in rows.orderBy("id").collect()]
    assert got == plain(n, seed)
    assert sorted(got) == list(range(n))


@pytest.mark.parametrize("n", [10**9, 10**13, MAX_ROWS])
def test_large_tables_have_places_below_their_size(spark, n):
    rows = spark.range(0, n, n // 5000).limit(5000).select(permuted_position(F.col("id"), F.lit(n).cast("long"), 1).alias("place"))
    places = [r.place for r in rows.collect()]
    assert len(set(places)) == 5000 and min(places) >= 0 and max(places) < n
    assert 0.45 * n < sum(places) / 5000 < 0.55 * n


def test_places_are_spread(spark):
    n = 20_000
    rows = spark.range(n).select("id", permuted_position(F.col("id"), F.lit(n).cast("long"), 9).alias("place"))
    cells = [r["count"] for r in rows.groupBy((F.col("id") / 1000).cast("int"), (F.col("place") / 1000).cast("int")).count().collect()]
    assert len(cells) == 400 and sum((c - 50) ** 2 / 50 for c in cells) < 500  # 399 degrees of freedom at most
    other = spark.range(n).select(permuted_position(F.col("id"), F.lit(n).cast("long"), 10).alias("place"))
    assert other.collect() != rows.select("place").collect()
    kept = [r.place for r in rows.orderBy("id").collect()]
    assert sum(abs(a - b) == 1 for a, b in zip(kept, kept[1:])) < 20


def corpus(spark, n=50):
    names = "CASE WHEN id % 5 = 0 THEN 'validation' WHEN id % 7 = 0 THEN 'extra' ELSE 'train' END"
    rows = spark.range(n).selectExpr("id AS doc_id", f"{names} AS split")
    counted = rows.selectExpr("*", "row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1L AS pos")
    return counted.selectExpr("*", "count(*) OVER (PARTITION BY split) AS split_rows")


def test_splits_have_their_sizes_and_dense_positions(spark):
    rows = permute_splits(corpus(spark), PrepareParams(n_val=4, n_test=3, n_train=10)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.split, []).append(r)
    assert {s: len(v) for s, v in by.items()} == {"train": 10, "validation": 4, "test": 3, "extra": 6}
    for name, own in by.items():
        assert sorted(r.pos for r in own) == list(range(len(own)))
        assert {r.split_rows for r in own} == {len(own)}
    assert all(r.doc_id % 5 for r in by["validation"])  # the delivered one is replaced


def test_without_a_holdout_the_order_stays(spark):
    before = corpus(spark)
    rows = permute_splits(before, PrepareParams(n_train=7, n_val=0))
    assert rows.where("split = 'train'").count() == 7
    same = permute_splits(before, PrepareParams())
    assert sorted(map(str, same.collect())) == sorted(map(str, before.select(*same.columns).collect()))


def test_a_holdout_of_everything_is_an_error(spark):
    with pytest.raises(Exception, match="leaves no train split"):
        permute_splits(corpus(spark), PrepareParams(n_val=30, n_test=10)).collect()


def test_null_splits_are_an_error(spark):
    rows = spark.createDataFrame([(1, None, 0, 1)], "doc_id long, split string, pos long, split_rows long")
    with pytest.raises(Exception, match="null value in column split"):
        permute_splits(rows, PrepareParams(n_val=1)).collect()


def test_nothing_moves(spark):
    rows = spark.range(100).selectExpr("id AS doc_id", "'train' AS split", "id AS pos", "100L AS split_rows")
    text = permute_splits(rows, PrepareParams(n_val=5, n_test=5, n_train=20))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text and "Python" not in text


def test_unknown_shuffles_are_refused():
    with pytest.raises(ValueError, match="shuffle"):
        PrepareParams(shuffle="random")
