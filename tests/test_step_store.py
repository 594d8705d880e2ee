"""Losses of stored steps against those of steps that move."""

import uuid

import pytest

from corpusweave.operators.metrics import token_losses
from corpusweave.sources.step_store import store_steps, stored_token_losses

SCHEMA = "seq_id LONG, pos LONG, logits ARRAY<FLOAT>, label INT"


@pytest.fixture
def stored(spark, tmp_path):
    names = []

    def store(rows, buckets):
        names.append(f"steps_{uuid.uuid4().hex}")
        return store_steps(spark.createDataFrame(rows, SCHEMA), names[-1], buckets, str(tmp_path / names[-1]))

    yield store
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def steps(n):
    labels = [(7 * i) % 5 if i % 3 else -100 for i in range(n)]
    return [(i // 9, (i % 9) * 2, [float((i * j) % 11) / 3 for j in range(5)], label) for i, label in enumerate(labels)]


def result(losses):
    return sorted(tuple(r) for r in losses.collect())


@pytest.mark.parametrize("buckets", [1, 4])
@pytest.mark.parametrize("partitions", [1, 7])
def test_the_same_losses(spark, stored, buckets, partitions):
    rows = steps(200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = result(stored_token_losses(stored(rows, buckets), buckets))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == result(token_losses(spark.createDataFrame(rows, SCHEMA)))


def test_one_sequence_holds_most_steps(spark, stored):
    rows = [(0, i, [float(i % 7), 1.0], i % 2) for i in range(3000)] + steps(20)[9:]
    assert result(stored_token_losses(stored(rows, 4), 4)) == result(token_losses(spark.createDataFrame(rows, SCHEMA)))


def test_no_steps_and_null_labels(spark, stored):
    assert stored_token_losses(stored([], 2), 2).collect() == []
    with pytest.raises(Exception, match="null value in column label"):
        stored_token_losses(stored([(0, 0, [1.0], 0), (0, 1, [1.0], None)], 2), 2).collect()


def test_logits_do_not_move(spark, stored):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = stored_token_losses(stored(steps(90), 4), 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    [scan] = [i for i, line in enumerate(lines) if "FileScan" in line and "logits#" in line]
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*"))
    above = []
    for line in reversed(lines[:scan]):
        here = len(line) - len(line.lstrip(" :+-*"))
        if here < depth:
            above, depth = [*above, line], here
    assert any("ShuffledHashJoin" in line for line in above)
    assert not any("Exchange" in line or "Sort " in line for line in above)
