import random

import public_tokenizers
import pytest
from cases import empty_table, odd_rows, odd_table

from corpusweave.llm.bpe import symbols
from corpusweave.llm.unigram import Unigram, count_tokens, load

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return Unigram.from_file(PATH)


def plain_count(model, word):
    """Fewest tokens among the best ways to cut one pre-token, by trying all cuts at every place."""
    spelled = symbols(word)
    best = [(0.0, 0)] + [(-float("inf"), 0)] * len(spelled)
    for end in range(1, len(spelled) + 1):
        for begin in range(max(0, end - 70), end):
            score = model.scores.get(spelled[begin:end])
            if score is not None:
                best[end] = max(best[end], (best[begin][0] + score, best[begin][1] - 1))
    return -best[-1][1], best[-1][0]


def test_counts_equal_plain_programming(spark, model):
    rows = {(r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in count_tokens(odd_table(spark, clashes=True), load(spark, PATH)).collect()}
    want = set()
    known = {}
    for doc_id, text, *_ in odd_rows():
        words = model.pretokens(text or "")
        for w in words:
            if w not in known:
                known[w] = plain_count(model, w)
        want.add((doc_id, len(words), sum(known[w][0] for w in words)))
    assert rows == want
    assert count_tokens(empty_table(spark), load(spark, PATH)).collect() == []


def test_prefixes_are_shared_and_all_bytes_can_be_cut(model):
    rng = random.Random(3)
    words = {"".join(chr(rng.randint(0, 0x3FF)) for _ in range(rng.randint(1, 12))) for _ in range(300)}
    model.count_pretokens(words)
    for w in words:
        n, score = plain_count(model, w)
        assert -model._known[w][1] == n
        assert model._known[w][0] == pytest.approx(score)


def test_probabilities_add_up(model):
    import math

    assert sum(map(math.exp, model.scores.values())) == pytest.approx(1)
