import random

import pytest
from pyspark.sql import functions as F

from corpusweave.operators.order import natural_order
from corpusweave.operators.pack import (
    pack_batches,
    pack_global,
    packing_accounts,
    packing_groups,
    truncate_documents,
)
from corpusweave.params import Specials

SPECIALS = Specials(pad=0, eos=1, bos=2, unk=3)
GOLDEN = [[10, 11, 1], [12, 1], [13, 14, 15, 1]]
SCHEMA = "split STRING, doc_id LONG, pos LONG, split_rows LONG, input_ids ARRAY<INT>, n_tokens LONG"


def docs(spark, lists, split="train"):
    rows = [(split, i, i, len(lists), ids, len(ids)) for i, ids in enumerate(lists)]
    return natural_order(spark.createDataFrame(rows, SCHEMA)).repartition(3)


def blocks(rows, order):
    return [r.input_ids for r in rows.orderBy(*order).collect()]


def by_hand(lists, length, shards, batch_rows):
    """Blocks in order, from plain lists cut into shards and batches."""
    out, n = [], len(lists)
    shards = min(shards, n)
    first = 0
    for s in range(shards):
        size = n // shards + (1 if s < n % shards else 0)
        for b in range(first, first + size, batch_rows):
            stream = [t for ids in lists[b : min(b + batch_rows, first + size)] for t in ids]
            while len(stream) >= length - 1:
                out.append([2] + stream[: length - 1])
                stream = stream[length - 1 :]
        first += size
    return out


@pytest.mark.parametrize(
    "length, batch_rows, want, dropped",
    [
        (4, 1000, [[2, 10, 11, 1], [2, 12, 1, 13], [2, 14, 15, 1]], 0),
        (5, 1000, [[2, 10, 11, 1, 12], [2, 1, 13, 14, 15]], 1),
        (11, 1000, [], 9),
        (10, 1000, [[2, 10, 11, 1, 12, 1, 13, 14, 15, 1]], 0),
        (4, 2, [[2, 10, 11, 1], [2, 13, 14, 15]], 3),
        (2, 1000, [[2, t] for ids in GOLDEN for t in ids], 0),
    ],
)
def test_golden_blocks(spark, length, batch_rows, want, dropped):
    rows = docs(spark, GOLDEN)
    got = pack_batches(rows, SPECIALS, length, 1, batch_rows)
    assert blocks(got, ["shard", "batch", "block"]) == want
    assert all(r.attention_mask == [1] * length for r in got.collect())
    accounts = packing_accounts(packing_groups(rows, 1, batch_rows), length).first()
    assert (accounts.blocks, accounts.tokens_in, accounts.tokens_dropped) == (len(want), 9, dropped)


@pytest.mark.parametrize("pack", [pack_batches, pack_global])
def test_a_block_needs_room_for_a_token(spark, pack):
    with pytest.raises(ValueError, match="at least 2"):
        pack(docs(spark, GOLDEN), SPECIALS, 1)


def bare_rows(spark, n):
    split, size = F.lit("train").alias("split"), F.lit(n).cast("long").alias("split_rows")
    return spark.range(n).select(split, F.col("id").alias("pos"), size)


def test_golden_groups(spark):
    got = packing_groups(bare_rows(spark, 10), 3, 2).orderBy("pos").collect()
    assert [(r.shard, r.batch) for r in got] == [
        (0, 0), (0, 0), (0, 1), (0, 1), (1, 0), (1, 0), (1, 1), (2, 0), (2, 0), (2, 1),
    ]


def test_fewer_rows_than_shards(spark):
    assert [r.shard for r in packing_groups(bare_rows(spark, 2), 12, 1000).orderBy("pos").collect()] == [0, 1]


def random_lists(seed, n, longest):
    rng = random.Random(seed)
    return [[rng.randrange(10, 99) for _ in range(rng.choice([0, 1, 5, longest]))] + [1] for _ in range(n)]


@pytest.mark.parametrize("length, shards, batch_rows", [(8, 1, 1000), (8, 3, 7), (33, 12, 5), (2, 4, 9), (500, 2, 40)])
@pytest.mark.parametrize("partitions", [1, 8])
def test_random_batches_equal_a_loop(spark, length, shards, batch_rows, partitions):
    lists = random_lists(length, 120, 200)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        packed = pack_batches(docs(spark, lists), SPECIALS, length, shards, batch_rows)
        got = blocks(packed, ["shard", "batch", "block"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == by_hand(lists, length, shards, batch_rows)


@pytest.mark.parametrize("length", [2, 17, 128, 5000])
def test_one_stream_loses_less_than_a_block(spark, length):
    lists = random_lists(length, 150, 300)
    got = blocks(pack_global(docs(spark, lists), SPECIALS, length), ["block"])
    assert got == by_hand(lists, length, 1, len(lists))
    kept = [t for b in got for t in b[1:]]
    stream = [t for ids in lists for t in ids]
    assert kept == stream[: len(kept)] and len(stream) - len(kept) < length - 1


def test_one_long_document_among_short_ones(spark):
    lists = [[5, 1], list(range(10, 60010)) + [1], [6, 1]]
    for rows in (pack_batches(docs(spark, lists), SPECIALS, 129), pack_global(docs(spark, lists), SPECIALS, 129)):
        assert blocks(rows, ["block"]) == by_hand(lists, 129, 1, 1000)


def test_splits_do_not_mix(spark):
    both = docs(spark, GOLDEN, "a").unionByName(docs(spark, [[7, 7, 1]], "b"))
    got = pack_batches(both, SPECIALS, 4)
    assert blocks(got.where("split = 'b'"), ["block"]) == [[2, 7, 7, 1]]
    assert got.where("split = 'a'").count() == 3


def test_truncation_keeps_the_head(spark):
    rows = docs(spark, GOLDEN).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    got = truncate_documents(rows, 3).orderBy("pos").collect()
    assert [r.input_ids for r in got] == [[10, 11, 1], [12, 1], [13, 14, 15]]
    assert [r.attention_mask for r in got] == [[1, 1, 1], [1, 1], [1, 1, 1]]
