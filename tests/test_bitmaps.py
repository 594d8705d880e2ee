"""Id sets as bitmaps against Python's sets."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusweave.operators import bitmaps as B
from corpusweave.operators.matrix import zero_rows

# Ends of buckets and of BIGINT, both signs.
IDS = [0, 1, 2, 7, 8, 32767, 32768, 32769, 65536, 65537, -1, -32767, -32768, -32769, 2**62, 2**63 - 1, -(2**63) + 1]


def rows(spark, ids, column="id"):
    return spark.createDataFrame([(i,) for i in ids], f"{column} LONG").repartition(3)


def ids_in(bitmaps):
    return sorted(r.id for r in B.ids_of(bitmaps).collect())


def test_ids_come_back(spark):
    found = B.id_bitmaps(rows(spark, [*IDS, *IDS, None]))
    assert ids_in(found) == sorted(IDS)
    assert B.id_count(found).first().ids == len(IDS)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(-70_000, 70_000), max_size=40), st.sets(st.integers(-70_000, 70_000), max_size=40))
def test_sets_meet_and_join(spark, first, second):
    a, b = B.id_bitmaps(rows(spark, [*first, *IDS[:9]])), B.id_bitmaps(rows(spark, [*second, *IDS[5:]]))
    first, second = first | set(IDS[:9]), second | set(IDS[5:])
    assert ids_in(B.both(a, b)) == sorted(first & second)
    assert ids_in(B.either(a, b)) == sorted(first | second)
    assert B.id_count(B.both(a, b)).first().ids == len(first & second)


@pytest.mark.parametrize("limit", [0, B.MAX_BITMAP_BYTES])
def test_membership_in_both_forms(spark, monkeypatch, limit):
    monkeypatch.setattr(B, "MAX_BITMAP_BYTES", limit)
    asked = spark.createDataFrame([(i, "x", "y") for i in [*IDS, 3, None]], "key LONG, bucket STRING, set_bitmap STRING")
    found = B.with_membership(asked, B.id_bitmaps(rows(spark, IDS[::2])), "key")
    assert found.columns == ["key", "bucket", "set_bitmap", "member"]
    assert {r.key: r.member for r in found.collect()} == {i: i in IDS[::2] for i in [*IDS, 3, None]}


def test_empty_sets(spark):
    none = B.id_bitmaps(rows(spark, []))
    assert ids_in(none) == [] and B.id_count(none).first().ids == 0
    some = B.id_bitmaps(rows(spark, [1]))
    assert ids_in(B.both(none, some)) == [] and ids_in(B.either(none, some)) == [1]
    assert [r.member for r in B.with_membership(rows(spark, [1]), none, "id").collect()] == [False]


def test_the_matrix_stays(spark):
    matrix = spark.createDataFrame([(i, [1.5, float(i)]) for i in range(20)], "vec_id LONG, embedding ARRAY<FLOAT>")
    ids = rows(spark, [3, 4, 19, 400])
    zeroed = B.zero_rows_by_bitmap(matrix, B.id_bitmaps(ids))
    assert zeroed.schema == matrix.schema
    assert sorted(map(tuple, zeroed.collect())) == sorted(map(tuple, zero_rows(matrix, ids).collect()))
    plan = zeroed._jdf.queryExecution().executedPlan().toString().split("BuildRight")[-1]
    above = plan.partition("BroadcastExchange")[0]
    assert "Exchange" not in above and "embedding" in above
