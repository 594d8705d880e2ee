"""The table function that packs, against blocks of built-in functions."""

import pytest

from corpusweave.operators.pack import pack_batches, packing_groups
from corpusweave.operators.streamed import pack_streamed
from corpusweave.params import Specials

SPECIALS = Specials(pad=0, eos=1, bos=2)
SCHEMA = "split STRING, pos LONG, split_rows LONG, input_ids ARRAY<INT>, text STRING"
COLUMNS = ["split", "shard", "batch", "block", "input_ids", "attention_mask"]


def docs(spark):
    rows = [("a", i, 40, [10 * i + j for j in range(i % 7)] + [1], "x") for i in range(40)]
    rows += [("b", i, 3, list(range(i * 500)) + [1], None) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def result(blocks):
    return sorted(tuple(r) for r in blocks.select(*COLUMNS).collect())


@pytest.mark.parametrize(("length", "shards", "batch_rows"), [(2, 1, 1000), (4, 3, 5), (11, 12, 2), (3000, 1, 1000)])
def test_the_same_blocks(spark, length, shards, batch_rows):
    streamed = pack_streamed(packing_groups(docs(spark), shards, batch_rows), length, SPECIALS.bos)
    assert result(streamed) == result(pack_batches(docs(spark), SPECIALS, length, shards, batch_rows))


def test_no_rows_and_wrong_lengths(spark):
    none = packing_groups(spark.createDataFrame([], SCHEMA), 2, 3)
    assert pack_streamed(none, 4, 2).collect() == []
    with pytest.raises(ValueError):
        pack_streamed(none, 1, 2)


def test_one_shuffle_by_group(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = packing_groups(spark.createDataFrame([("a", 0, 1, [1], "x")], SCHEMA), 2, 3)
        plan = pack_streamed(rows, 4, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange ") == 1
    assert "SinglePartition" not in plan
