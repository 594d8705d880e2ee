import pytest

from corpusweave.operators.collate import collate
from corpusweave.params import Specials

SCHEMA = "split STRING, pos LONG, input_ids ARRAY<INT>, attention_mask ARRAY<INT>"


def rows(spark, lists):
    return spark.createDataFrame([("train", i, ids, [1] * len(ids)) for i, ids in enumerate(lists)], SCHEMA)


def collated(spark, lists, specials, **kw):
    got = collate(rows(spark, lists), specials, **kw).orderBy("pos").collect()
    return [(r.input_ids, r.attention_mask, r.labels) for r in got]


def test_left_padding(spark):
    got = collated(spark, [[5, 6], [7]], Specials(pad=0, eos=1, bos=2))
    assert got == [([5, 6], [1, 1], [5, 6]), ([0, 7], [0, 1], [-100, 7])]


def test_right_padding(spark):
    got = collated(spark, [[5, 6], [7]], Specials(pad=0, eos=1, bos=2), side="right")
    assert got[1] == ([7, 0], [1, 0], [7, -100])


def test_pad_falls_back_to_eos_and_hides_its_labels(spark):
    got = collated(spark, [[5, 1], [7]], Specials(eos=1, bos=2))
    assert got == [([5, 1], [1, 1], [5, -100]), ([1, 7], [0, 1], [-100, 7])]


def test_width_is_per_batch(spark):
    got = collated(spark, [[5], [6], [7, 7, 7], [8], [9]], Specials(pad=0, eos=1, bos=2))
    assert [len(ids) for ids, _, _ in got] == [1, 1, 3, 3, 1]


def test_unknown_side(spark):
    with pytest.raises(ValueError, match="side"):
        collate(rows(spark, [[1]]), Specials(pad=0, eos=1, bos=2), side="up")


def test_a_batch_that_lacks_rows_goes(spark):
    found = spark.createDataFrame(
        [("a", i, [1] * (i + 1), [1] * (i + 1)) for i in range(5)] + [("b", 0, [1], [1])], SCHEMA
    )
    kept = collate(found, Specials(eos=1, bos=2, pad=0), 2, drop_last=True).collect()
    assert sorted((r.split, r.pos, len(r.input_ids)) for r in kept) == [("a", 0, 2), ("a", 1, 2), ("a", 2, 4), ("a", 3, 4)]
    assert collate(found.where("split = 'b'"), Specials(eos=1, bos=2, pad=0), 2, drop_last=True).collect() == []
