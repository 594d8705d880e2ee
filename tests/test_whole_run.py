"""Whole runs against a plain loop, over random corpora and parameters."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusweave import PrepareParams, Specials, prepare_corpus

SPECIALS = Specials(pad=0, eos=1, bos=2, unk=3)
VOCAB = {"a": 10, "b": 11, "c": 12}


def by_hand(texts, p):
    """Blocks of each split, in order, from lists."""
    order = list(range(len(texts)))
    parts = {}
    if p.n_val or p.n_test:
        order.sort(key=lambda i: (hashlib.md5(f"{p.seed}:{i}".encode()).hexdigest()[:15], i))
        if p.n_val:
            order, parts["validation"] = order[: -p.n_val], order[-p.n_val :]
        if p.n_test:
            order, parts["test"] = order[: -p.n_test], order[-p.n_test :]
    parts["train"] = order
    if p.n_train:
        limits = {"train": p.n_train, "validation": p.n_val, "test": p.n_test}
        parts = {name: rows[: limits[name] or len(rows)] for name, rows in parts.items()}
    return {name: packed([encoded(texts[i]) for i in rows], p) for name, rows in parts.items()}


def encoded(text):
    return [VOCAB.get(w, 3) for w in text.split()] + [1]


def packed(lists, p):
    if not p.use_packing:
        return [ids[: p.max_seq_length] for ids in lists]
    out, size = [], p.max_seq_length - 1
    shards = 1 if p.grouping == "global" else min(p.shards, len(lists))
    rows = len(lists) if p.grouping == "global" else p.batch_rows
    base, extra, first = len(lists) // shards, len(lists) % shards, 0
    for s in range(shards):
        after = first + base + (s < extra)
        for b in range(first, after, rows):
            stream = [t for ids in lists[b : min(b + rows, after)] for t in ids]
            out += [[2] + stream[k : k + size] for k in range(0, len(stream) - size + 1, size)]
        first = after
    return out


texts_ = st.lists(st.text(alphabet="abz ", max_size=40), min_size=12, max_size=60)
small = st.one_of(st.none(), st.integers(0, 5))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    texts=texts_,
    n_train=st.one_of(st.none(), st.integers(1, 40)),
    n_val=small,
    n_test=small,
    length=st.integers(2, 30),
    shards=st.integers(1, 70),
    batch_rows=st.integers(1, 20),
    seed=st.integers(0, 9),
    mode=st.sampled_from(["batches", "global", "truncate"]),
)
def test_whole_run_equals_a_loop(spark, texts, n_train, n_val, n_test, length, shards, batch_rows, seed, mode):
    params = PrepareParams(
        max_seq_length=length,
        n_train=n_train,
        n_val=n_val,
        n_test=n_test,
        shards=shards,
        batch_rows=batch_rows,
        seed=seed,
        use_packing=mode != "truncate",
        grouping="global" if mode == "global" else "batches",
    )
    corpus = spark.createDataFrame(
        [(i, t, "train") for i, t in enumerate(texts)], "doc_id LONG, text STRING, split STRING"
    )
    vocab = spark.createDataFrame(list(VOCAB.items()), "token STRING, id INT")
    rows = prepare_corpus(corpus, vocab, SPECIALS, params)
    place = [c for c in ("split", "pos", "shard", "batch", "block") if c in rows.columns]
    got = {}
    for r in rows.orderBy(*place).collect():
        got.setdefault(r.split, []).append(r.input_ids)
    assert got == {name: blocks for name, blocks in by_hand(texts, params).items() if blocks}


def test_the_loop_itself(spark):
    p = PrepareParams(max_seq_length=4, shards=1)
    assert packed([[10, 11, 1], [12, 1], [13, 14, 15, 1]], p) == [[2, 10, 11, 1], [2, 12, 1, 13], [2, 14, 15, 1]]
    with pytest.raises(ValueError):
        PrepareParams(max_seq_length=1)
