import math

import numpy as np
import pytest

from corpusweave.operators.metrics import perplexity, sequence_losses, token_losses

SCHEMA = "seq_id LONG, pos LONG, logits ARRAY<FLOAT>, label INT"


def steps(spark, sequences):
    rows = [(s, p, z, y) for s, seq in enumerate(sequences) for p, (z, y) in enumerate(seq)]
    return spark.createDataFrame(rows, SCHEMA)


def nested(spark, sequences):
    rows = [(s, [z for z, _ in seq], [y for _, y in seq]) for s, seq in enumerate(sequences)]
    return spark.createDataFrame(rows, "seq_id LONG, logits ARRAY<ARRAY<FLOAT>>, labels ARRAY<INT>")


def both(spark, sequences):
    a = perplexity(token_losses(steps(spark, sequences))).first()
    b = perplexity(sequence_losses(nested(spark, sequences))).first()
    assert repr(tuple(a)) == repr(tuple(b))
    return a.eval_loss, a.perplexity


EVEN = [0.0, 0.0]


def test_one_valid_pair(spark):
    loss, value = both(spark, [[(EVEN, 0), (EVEN, 1), (EVEN, -100)]])
    assert (loss, value) == (pytest.approx(math.log(2)), pytest.approx(2))


@pytest.mark.parametrize("sequences", [[[(EVEN, -100), (EVEN, -100)]], [[(EVEN, 1)], [(EVEN, 0)]]])
def test_no_valid_token(spark, sequences):
    assert both(spark, sequences) == (math.inf, math.inf)


@pytest.mark.parametrize("loss, value", [(25.0, math.inf), (800.0, math.inf), (20.0, math.exp(20))])
def test_large_losses_are_kept_but_their_perplexity_is_not(spark, loss, value):
    got = perplexity(spark.createDataFrame([(loss,)], "loss DOUBLE")).first()
    assert got.eval_loss == loss and got.perplexity == pytest.approx(value)


def test_nan_stays_nan(spark):
    loss, value = both(spark, [[([math.nan, 0.0], 0), (EVEN, 1)]])
    assert math.isnan(loss) and math.isnan(value)


def test_large_logits_do_not_overflow(spark):
    loss, _ = both(spark, [[([1000.0, 0.0], 0), (EVEN, 1)]])
    assert loss == pytest.approx(1000)


def test_wide_logits_cost_their_width(spark):
    """Work that grew with the square of the width would not end here."""
    width = 100_000
    logits = np.random.default_rng(5).normal(size=(40, width)).astype(np.float32)
    rows = [(s, 0, logits[s].tolist(), 0) for s in range(40)] + [(s, 1, [0.0], s * 7) for s in range(40)]
    got = {r.seq_id: r.loss for r in token_losses(spark.createDataFrame(rows, SCHEMA)).collect()}
    wide = logits.astype(np.float64)
    want = np.log(np.exp(wide).sum(axis=1)) - wide[np.arange(40), np.arange(40) * 7]
    assert got == {s: pytest.approx(want[s]) for s in range(40)}


def test_sequences_do_not_reach_into_each_other(spark):
    sharp = [9.0, 0.0]
    loss, _ = both(spark, [[(sharp, 1), (EVEN, 0)], [(EVEN, 1), (EVEN, 1)]])
    assert loss == pytest.approx((math.log(1 + math.exp(-9)) + math.log(2)) / 2)


@pytest.mark.parametrize("label", [2, -1, -7])
def test_a_label_outside_the_logits_fails(spark, label):
    bad = [[(EVEN, 0), (EVEN, label)]]
    for losses in (token_losses(steps(spark, bad)), sequence_losses(nested(spark, bad))):
        with pytest.raises(Exception, match="label outside"):
            losses.collect()


def test_groups(spark):
    losses = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 30.0)], "kind STRING, loss DOUBLE")
    got = {r.kind: (r.eval_loss, r.perplexity) for r in perplexity(losses, ["kind"]).collect()}
    assert got == {"a": (2.0, pytest.approx(math.exp(2))), "b": (30.0, math.inf)}


def test_gaps_pair_with_the_next_step_there_is(spark):
    rows = [(0, 0, [0.0, 0.0], 1), (0, 2, [0.0, 0.0], 1), (0, 7, [0.0, 0.0], -100)]
    got = token_losses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.pos, r.target) for r in got] == [(0, 1)]


def test_null_labels_fail(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0], 1), (0, 1, [0.0, 0.0], None)], SCHEMA)
    with pytest.raises(Exception, match="null value in column label"):
        token_losses(rows).collect()
    arrays = spark.createDataFrame([(0, [[0.0], [0.0]], [0, None])], "seq_id LONG, logits ARRAY<ARRAY<FLOAT>>, labels ARRAY<INT>")
    with pytest.raises(Exception, match="null value in column label"):
        sequence_losses(arrays).collect()


def test_wide_logits(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    logits = (rng.standard_normal((3, 5000)) * 50).astype(np.float32)
    rows = [(0, i, row.tolist(), 4999 - i) for i, row in enumerate(logits)]
    got = {r.pos: r.loss for r in token_losses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(2):
        z = logits[i].astype(float)
        want = z.max() + np.log(np.exp(z - z.max()).sum()) - z[4999 - (i + 1)]
        assert got[i] == pytest.approx(want, rel=1e-9)
