import random
import zlib

import numpy as np
import pytest
from cases import SCHEMA, empty_table, odd_rows, odd_table, words

from corpusweave.llm import gru, toxicity
from corpusweave.llm.toxicity import Scorer, fit, sample, score_toxicity, standing_out


def labelled(n, seed=1):
    """Texts that are toxic by one of a few words, now and then wrongly labelled."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        ws, toxic = words(rng, rng.randint(5, 150)).split(), rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 4)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vilx", "horridly.", "QUOG", "quogging"]))
        rows.append((" ".join(ws), int(toxic if rng.random() > 0.03 else not toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    return fit(labelled(500))


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    params = {k: v.astype(np.float64) for k, v in gru.start(5).items()}
    distinct = [b"ab", b"c", b"def", b"gh"]
    ids = np.array([0, 1, 2, 5])
    vectors = rng.standard_normal((4, gru.WORD_DIM + gru.CHAR_DIM))
    first, size, _ = gru.windows(np.array([40, 3]))
    at, mask = gru.places(first, size, rng.integers(0, 4, 43))
    pull = rng.standard_normal(len(at))

    def loss():
        return float(gru.forward(params, gru.project(params, vectors), at, mask) @ pull)

    keep: list = []
    gru.forward(params, gru.project(params, vectors), at, mask, keep)
    grads, of_vectors = gru.backward(params, vectors, at, mask, keep, pull)
    grads["vectors"] = of_vectors
    for name, grad in grads.items():
        target = vectors if name == "vectors" else params[name]
        for _ in range(4):
            place = tuple(rng.integers(0, s) for s in target.shape)
            held, step = target[place], 1e-2
            target[place] = held + step
            up = loss()
            target[place] = held - step
            down = loss()
            target[place] = held
            assert grad[place] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=2e-3), name
    assert len(gru.embed(params, distinct, ids)) == 4


def test_held_out_accuracy(model):
    rows = labelled(400, seed=2)
    scores, _ = Scorer(model).scores([t for t, _ in rows])
    truth = np.array([any(w in t.lower() for w in ("vilx", "horridly", "quog")) for t, _ in rows])
    assert ((scores >= 0.5) == truth).mean() > 0.95


def test_a_toxic_passage_in_a_long_text_counts(model):
    rng = random.Random(3)
    clean = words(rng, 4000)
    scorer = Scorer(model)
    (low,), (n,) = scorer.scores([clean])
    (high,), _ = scorer.scores([clean + " vilx quog horridly " + clean])
    assert low < 0.5 <= high
    assert n == 249


def plain_score(model, text):
    """The most toxic window's score by loops over windows, words and directions."""
    params, ws, h = model["params"], gru.words_of(text), gru.HIDDEN
    logits = []
    for first in range(0, max(1, len(ws) - gru.WINDOW + gru.STRIDE), gru.STRIDE):
        window = ws[first : first + gru.WINDOW]
        vectors = [gru.embed(params, [w], np.array([model["known"].get(w, 0)]))[0] for w in window]
        states = {}
        for side, order in (("f", range(len(window))), ("b", reversed(range(len(window))))):
            state = np.zeros(h)
            for t in order:
                gates, own = vectors[t] @ params[f"in_{side}"] + params[f"bias_{side}"], state @ params[f"rec_{side}"]
                z, r = gru.sigmoid(gates[:h] + own[:h]), gru.sigmoid(gates[h : 2 * h] + own[h : 2 * h])
                new = np.tanh(gates[2 * h :] + r * own[2 * h :])
                state = states[side, t] = z * state + (1 - z) * new
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(window))]
        looked = np.array([np.tanh(s @ params["att_w"] + params["att_b"]) @ params["att_v"] for s in both])
        weights = np.exp(looked - looked.max())
        pooled = sum(w * s for w, s in zip(weights / weights.sum(), both, strict=True))
        logits.append(pooled @ params["out_w"] + params["out_b"][0])
    return gru.sigmoid(max(logits))


def test_scores_equal_a_plain_loop(model):
    rng = random.Random(8)
    texts = [t for t, _ in labelled(20, seed=9)] + [words(rng, n) + " quog" for n in (0, 30, 31, 32, 47, 48, 300)]
    found, _ = Scorer(model).scores(texts)
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=1e-4)


def test_windows_cover_every_word():
    for n in range(0, 120):
        first, size, text = gru.windows(np.array([7, n, 2]))
        own = text == 1
        covered = {i for f, s in zip(first[own] - 7, size[own], strict=True) for i in range(f, f + s)}
        assert covered == set(range(n))
        assert all(a + gru.STRIDE == b for a, b in zip(first[own], first[own][1:], strict=False))


def test_scores_do_not_depend_on_neighbours(model, monkeypatch):
    texts = [t for t, _ in labelled(60, seed=4)]
    whole = Scorer(model).scores(texts)[0]
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 3)
    one_by_one = Scorer(model)
    assert np.allclose(whole, [one_by_one.scores([t])[0][0] for t in texts], atol=1e-5)


def test_rows_of_odd_tables(spark, model):
    rows = score_toxicity(odd_table(spark, clashes=True), model).collect()
    assert len(rows) == len(odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    empty = {r["score"] for r in rows if r["n_windows"] == 0}
    assert empty == {model["share"]}
    assert score_toxicity(empty_table(spark), model).collect() == []


def test_sample_is_bounded_and_leaves_fold_0_out(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TEXTS", 7)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 4)
    docs = spark.createDataFrame([(i, f"{i:06d}", "en", "s", 0) for i in range(100)] + [(None, "x", "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)] + [(None, 1, 1), (5, 1, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 6)
    found = sample(docs, labels)
    assert len(found) == 7
    assert all(zlib.crc32(str(int(t)).encode()) % 5 and y == int(t) % 2 for t, y in found)
    assert sample(empty_table(spark), labels) == []


def test_texts_are_learned_from_whole_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 10)
    docs = spark.createDataFrame([(i, "x" * i, "en", "s", 0) for i in range(1, 30)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    assert sorted(len(t) for t, _ in sample(docs, labels)) == [i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 5]


def test_models_without_labels_or_words_know_the_share():
    for rows in ([], [("a b c", 1)], [("a", 0), ("b", 0)]):
        found = fit(rows)
        assert not found["fitted"]
        assert Scorer(found).scores(["a b", ""])[0].tolist() == [found["share"]] * 2
    assert 0 < fit([("", 0), ("", 1)])["share"] < 1
    assert Scorer(fit([("", 0), ("", 1)])).scores(["", "x"])[0].shape == (2,)


def test_chance_words_do_not_stand_out():
    n = np.array([3, 3, 40, 40, 200] + [10] * 5000)
    found = standing_out(n, np.array([3, 0, 4, 40, 20] + [1] * 5000), 0.1)
    assert (found[[0, 1, 2, 4]] == 0).all() and found[3] > 1


def test_equal_seeds_give_equal_models():
    rows = labelled(80, seed=6)
    a, b = fit(rows)["params"], fit(rows)["params"]
    assert all((a[k] == b[k]).all() for k in a)
