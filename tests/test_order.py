import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators.order import (
    cutoffs,
    head_tail,
    natural_order,
    positions,
    running_totals,
    seeded_order,
    unique_sorted,
)


def rows(spark, ids, split="train"):
    return spark.createDataFrame([(i, split) for i in ids], "doc_id LONG, split STRING")


LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
SPARSE = [*random.Random(7).sample(range(1 << 62), 150), *(-1 - i for i in random.Random(8).sample(range(1 << 62), 150)), 3, 4, 5]


@pytest.mark.parametrize("ids", [list(range(50)), SPARSE, [0, GREATEST, LEAST, -1]])
def test_natural_positions_of_dense_and_sparse_ids(spark, ids):
    got = positions(natural_order(rows(spark, ids))).collect()
    assert {r.doc_id: r.pos for r in got} == {i: n for n, i in enumerate(sorted(ids))}
    assert {r.split_rows for r in got} == {len(ids)}


def test_positions_start_anew_in_each_split(spark):
    both = rows(spark, range(10), "a").unionByName(rows(spark, range(10, 14), "b"))
    got = positions(natural_order(both)).where("split = 'b'").orderBy("doc_id").collect()
    assert [(r.doc_id, r.pos, r.split_rows) for r in got] == [(10, 0, 4), (11, 1, 4), (12, 2, 4), (13, 3, 4)]


def test_weighted_positions_give_offsets(spark):
    weighted = natural_order(rows(spark, SPARSE)).withColumn("w", F.pmod("doc_id", F.lit(5)) + 1)
    got = positions(weighted, weight="w").orderBy("doc_id").collect()
    total = 0
    assert [r.doc_id for r in got] == sorted(SPARSE)
    for r in got:
        assert r.start == total
        total += r.w
    assert {r.split_weight for r in got} == {total}


def test_null_ids_fail_in_natural_order(spark):
    with pytest.raises(Exception, match="null value in column id"):
        positions(natural_order(rows(spark, [1, None]))).collect()


@pytest.mark.parametrize("level_bits", [20, 3, 12])
def test_running_totals_of_any_buckets(spark, monkeypatch, level_bits):
    monkeypatch.setattr("corpusweave.operators.order.LEVEL_BITS", level_bits)
    rng = random.Random(5)
    buckets = [*range(6), *rng.sample(range(-(1 << 53), 1 << 53), 200), (1 << 20) - 1, 1 << 20, 1 << 40]
    table = spark.createDataFrame([("a", b, b % 7 + 1) for b in buckets] + [("b", 3, 5)], "k STRING, b LONG, v LONG")
    found = {(r.k, r.b): (r.before_v, r.all_v) for r in running_totals(table, ["k"], "b", ["v"]).collect()}
    total, whole = 0, sum(b % 7 + 1 for b in buckets)
    for b in sorted(buckets):
        assert found["a", b] == (total, whole)
        total += b % 7 + 1
    assert found["b", 3] == (0, 5)


def test_null_ids_and_splits_fail_rather_than_vanish(spark):
    with pytest.raises(Exception, match="null value in column id"):
        positions(seeded_order(rows(spark, [1, None]), 42)).collect()
    with pytest.raises(Exception, match="null value in column split"):
        positions(natural_order(rows(spark, [1, 2], None))).collect()


def test_same_seed_same_order_under_any_partitioning(spark):
    def order(seed, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            got = positions(seeded_order(rows(spark, range(500)).repartition(partitions), seed)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return {r.doc_id: r.pos for r in got}

    first = order(42, 1)
    assert sorted(first.values()) == list(range(500))
    assert first == order(42, 8) == order(42, 64)
    assert first != order(43, 8)


def test_cutoffs_at_any_rank(spark):
    ordered = seeded_order(rows(spark, range(200)), 42)
    expected = [(r.order_key, r.doc_id) for r in ordered.orderBy("order_key", "doc_id").collect()]
    size, found = cutoffs(ordered, [0, 57, 199, 200, -1, -200, -201])
    assert size == 200
    assert found == {r: expected[r] for r in (0, 57, 199, -1, -200)}


def test_cutoffs_of_nothing(spark):
    assert cutoffs(seeded_order(rows(spark, []), 42), [0]) == (0, {})


def test_head_and_tail_repeat_rows_of_a_short_table(spark):
    got = head_tail(rows(spark, [1, 2]).select("doc_id"), "doc_id", 3, 3).collect()
    assert sorted((r.part, r.doc_id) for r in got) == [("head", 1), ("head", 2), ("tail", 1), ("tail", 2)]


def test_unique_sorted(spark):
    ids = spark.createDataFrame([(3,), (1,), (3,)], "id INT")
    assert [r.id for r in unique_sorted(ids).collect()] == [1, 3]
