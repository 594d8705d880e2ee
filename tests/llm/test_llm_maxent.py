import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, empty_table, odd_rows, odd_table

from corpusweave.llm import maxent
from corpusweave.llm.maxent import ID_BITS, KNOWN, N_WEIGHTS, Model, score_texts, sequences, summed_gradient, tokens_of


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def plain_base(rows):
    counts = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    found = []
    for r in rows:
        own = tokens(r[1])
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        found.append((str(r[0]), held(r[0]), len(own), sum(counts[t] > 0 for t in own), n, round(score, 6)))
    return Counter(found)


@pytest.mark.parametrize("block_chars", [200, 4_000_000])
def test_base_scores_equal_plain_ones(spark, monkeypatch, block_chars):
    rows = [(r[0], r[1].replace("x" * 50_000, "xx") if r[1] else r[1], *r[2:]) for r in odd_rows()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(maxent, "BLOCK_CHARS", block_chars)
    found = score_texts(docs, rounds=2).collect()
    got = Counter((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == plain_base(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_clashing_columns_and_empty_tables(spark):
    assert score_texts(odd_table(spark, clashes=True), rounds=1).count() == len(odd_rows())
    assert score_texts(empty_table(spark)).collect() == []


def test_probabilities_add_up_in_every_context():
    rng = np.random.default_rng(1)
    weights = rng.standard_normal(N_WEIGHTS).astype(np.float32)
    model = Model(rng.integers(0, 500, KNOWN), weights)
    for context in (0, 5, (17 << ID_BITS) | 900):
        logs = model.log10((context << ID_BITS) + np.arange(KNOWN))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, KNOWN)
    weights = (rng.standard_normal(N_WEIGHTS) * 0.1).astype(np.float64)
    distinct = np.unique(rng.integers(0, 40, 200) << 2 * ID_BITS | rng.integers(0, 40, 200) << ID_BITS | rng.integers(0, 900, 200))
    n = rng.integers(1, 9, len(distinct))
    gradient, observed = Model(counts, weights).gradient(distinct, n)
    assert observed.sum() == pytest.approx(6 * n.sum())

    def likelihood(w):
        return float((Model(counts, w).log10(distinct) * n).sum() * math.log(10))

    for place in rng.choice(np.flatnonzero(gradient), 12, replace=False):
        up, down = weights.copy(), weights.copy()
        up[place] += 1e-3
        down[place] -= 1e-3
        assert gradient[place] == pytest.approx((likelihood(up) - likelihood(down)) / 2e-3, rel=1e-2, abs=1e-2)


def test_gradients_add_up_over_tasks(spark):
    rng = np.random.default_rng(4)
    counts, weights = rng.integers(0, 50, KNOWN), np.zeros(N_WEIGHTS, np.float32)
    distinct = np.unique(rng.integers(0, 1 << 3 * ID_BITS, 500))
    n = rng.integers(1, 5, len(distinct))
    table = spark.createDataFrame([(int(s), int(c)) for s, c in zip(distinct, n, strict=True)], "sequence long, n long").repartition(3)
    gradient, observed = summed_gradient(table, spark.sparkContext.broadcast((counts, weights)))
    want, seen = Model(counts, weights).gradient(distinct, n)
    assert np.allclose(gradient, want, atol=1e-3) and np.allclose(observed, seen, atol=1e-3)


def test_context_helps_on_held_out_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        ws = []
        while len(ws) < 60:
            ws += rng.choice(["new york city", "the big house", "to be or not", "i am here"]).split()
        rows.append((i, " ".join(ws), "en", "s", 0))
    found = [r for r in score_texts(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert len(found) > 10
    assert sum(r["score"] for r in found) > 0.6 * sum(r["base_score"] for r in found)


def test_sequences_start_anew_in_each_text():
    ids, sizes = np.array([5, 6, 7, 0, 0, 8, 0]), np.array([4, 1, 2])
    want = [(0, 0, 5), (0, 5, 6), (5, 6, 7), (6, 7, 0), (0, 0, 0), (0, 0, 8), (0, 8, 0)]
    assert [((s >> 20), (s >> 10) & 1023, s & 1023) for s in sequences(ids, sizes).tolist()] == want


def test_tokens():
    words, places, sizes = tokens_of(["A b", "", "\x1cb É"])
    assert sizes.tolist() == [3, 1, 3]
    assert [words[i] for i in places] == [b"a", b"b", b"", b"", b"\x1cb", "É".encode(), b""]


def rare_words(spark, monkeypatch):
    """Scores where only the end and two words are known one by one, of texts whose rare words come in fixed pairs."""
    rng = random.Random(6)
    pairs = [(f"left{i}", f"right{i}") for i in range(20)]
    texts = [" ".join(w for _ in range(20) for w in ("and", *rng.choice(pairs), "or")) for _ in range(200)]
    texts += ["and left3 right3 or " * 9, "and left3 right8 or " * 9, "and right8 left3 or " * 9]
    monkeypatch.setattr(maxent, "vocabulary", lambda counts, own=maxent.vocabulary: few_known(own, counts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: r for r in score_texts(docs.repartition(3)).collect()}


def few_known(own, counts):
    """The vocabulary with all but two words moved to the groups."""
    found = own(counts)
    rest = {w: i for w, i in found.known.items() if i >= 4}
    for word, i in rest.items():
        group = maxent.groups_of([word])[0]
        found.group_n[group] += found.counts[i]
        found.group_v[group] += 1
        found.counts[maxent.OTHER] += found.counts[i]
        found.counts[i] = 0
        del found.known[word]
    return found


def test_words_outside_of_the_known_ones_depend_on_what_is_before_them(spark, monkeypatch):
    found = rare_words(spark, monkeypatch)
    met, strange, turned = (found[i] for i in (200, 201, 202))
    assert met["score"] > strange["score"] + 5 > turned["score"] + 10
    assert met["score"] > met["base_score"] and strange["base_score"] == pytest.approx(turned["base_score"])


def test_words_of_all_groups_add_up(spark):
    rng = random.Random(7)
    rows = [(f"w{i}", rng.randint(1, 40)) for i in range(3 * KNOWN)] + [("", 50)]
    vocab = maxent.vocabulary(spark.createDataFrame(rows, "word string, count long"))
    rest = [(w, n) for w, n in rows if w not in vocab.known]
    assert len(rest) == 2 * KNOWN + 2 and vocab.group_n.sum() == sum(n for _, n in rest) == vocab.counts[maxent.OTHER]
    groups, counts = maxent.groups_of([w for w, _ in rest]), np.array([n for _, n in rest])
    shares = np.bincount(groups, 10 ** vocab.in_group(counts, groups), KNOWN)
    unseen = 10 ** vocab.in_group(np.zeros(KNOWN), np.arange(KNOWN))
    assert np.allclose(shares + unseen, 1)
    assert np.bincount(groups, minlength=KNOWN).tolist() == vocab.group_v.tolist()


def test_stored_blocks_stay_in_their_buckets_and_go_to_python_one_by_one(spark):
    plan = score_texts(odd_table(spark), rounds=1)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Scan parquet")]
    assert "FlatMapGroupsInArrow" in above and "MapInArrow " not in above.replace("FlatMapGroupsInArrow ", "")
    assert "Exchange" not in above
