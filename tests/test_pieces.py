"""Pieces of words against a plain loop, and texts that come back to the byte."""

import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from corpusweave import PrepareParams, Specials, prepare_corpus
from corpusweave.operators import pieces as P
from corpusweave.operators.encode import decode, encode, texts

SPECIALS = Specials(pad=0, eos=1, bos=2, unk=3)
FIXED = ["<pad>", "<eos>", "<bos>", "<unk>", P.WORD, *P.BYTES]
LISTED = ["a", "ab", "abcd", "b", "##b", "##bc", "##c", "##cde", "##dea", "ї", "##ї", "#", "##", "##eab"]
TOKENS = [*FIXED, *LISTED]
IDS = {token: i for i, token in enumerate(TOKENS)}
BLANK = "[ \t\n\x0b\x0c\r]"


def cut_by_hand(word, table):
    listed = set(table) - set(FIXED)
    begins = [t for t in listed if not t.startswith("##") or t == "##"]
    inner = [t[2:] for t in listed if t.startswith("##") and t != "##"]
    best = max((t for t in begins if word.startswith(t)), key=len, default="")
    ids, at = [table[best or P.WORD]], len(best)
    while at < len(word):
        best = max((t for t in inner if word.startswith(t, at)), key=len, default="")
        ids += [table["##" + best]] if best else [table[P.BYTES[b]] for b in word[at].encode()]
        at += len(best) or 1
    return ids


def by_hand(text):
    words, blanks = re.split(BLANK, text), ["", *re.findall(BLANK, text), ""]
    ids = []
    for word, before, after in zip(words, blanks, blanks[1:]):
        if before not in ("", " "):
            ids.append(IDS[P.BYTES[ord(before)]])
        if word or " " in (before, after):
            ids += cut_by_hand(word, IDS)
    return ids


TRIE = P.piece_trie(TOKENS, list(IDS.values()), SPECIALS.ids())
TEXTS = P.piece_texts(TOKENS, list(IDS.values()))
GIVEN = ["", " ", "\n", "  ", "\n \n", " a", "a ", "abcde ab  x", "<w> <eos> <0x41>", "##b ## #", "ї₴\U0001f600", "\x00a", "a\n\nb\r\n c"]
LETTERS = st.text(alphabet="aabbcde#ї₴\U0001f600 \n\t<w>", max_size=30)


def both_ways(batch):
    ids = P.batch_ids(TRIE, batch)
    return ids.to_pylist(), P.batch_texts(TEXTS, ids).to_pylist()


@pytest.mark.parametrize("few", [0, 32])
def test_pieces_agree_with_a_loop(monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    assert both_ways(pa.array(GIVEN)) == ([by_hand(t) for t in GIVEN], GIVEN)


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, max_size=60), st.sampled_from([0, 5, 32]))
def test_pieces_of_random_texts(found, few):
    before, P.FEW = P.FEW, few
    try:
        assert both_ways(pa.array(found, pa.string())) == ([by_hand(t) for t in found], found)
    finally:
        P.FEW = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=5), max_size=12), st.text(alphabet="ab", max_size=40))
def test_any_vocabulary_takes_the_longest_match(bodies, word):
    listed = sorted({"##" * (i % 2) + body for i, body in enumerate(bodies)})
    table = {t: i for i, t in enumerate([*FIXED, *listed])}
    trie = P.piece_trie(list(table), list(table.values()), [0, 1, 2, 3])
    assert P.batch_ids(trie, pa.array([word])).to_pylist()[0] == (cut_by_hand(word, table) if word else [])


def test_nulls_slices_and_wide_strings():
    rows = ["zz  ", None, "", "ab\nc", None]
    want = [None if t is None else by_hand(t) for t in rows]
    for batch in (pa.array(rows), pa.array(["x y", *rows]).slice(1), pa.array(rows, pa.large_string())):
        assert both_ways(batch) == (want, rows)
    assert both_ways(pa.array([None], pa.string())) == ([None], [None])
    assert both_ways(pa.array([], pa.string())) == ([], [])


@pytest.mark.parametrize("size", [1, 7, 40])
def test_small_slices(monkeypatch, size):
    monkeypatch.setattr(P, "SLICE_BYTES", size)
    rows = [None, *GIVEN, None, "", "a" * 100, "", None]
    want = [None if t is None else by_hand(t) for t in rows]
    for batch in (pa.array(rows), pa.array(["x y", *rows]).slice(1), pa.array([None, "", None], pa.string())):
        assert both_ways(batch)[1] == batch.to_pylist()
    assert both_ways(pa.array(rows))[0] == want


def test_a_very_long_word():
    word = "abcdeab" * 40_000 + "₴"
    assert both_ways(pa.array([word])) == ([by_hand(word)], [word])


def test_ids_that_no_encoding_gives():
    rows = pa.array([[IDS["<0xE2>"], IDS["<0x82>"]], [9999, IDS["a"]], [], [IDS["##c"], IDS["a"]]], pa.list_(pa.int32()))
    assert P.batch_texts(TEXTS, rows).to_pylist() == ["�", "a", "", "c a"]


def test_a_vocabulary_without_bytes_is_refused():
    with pytest.raises(ValueError, match="<0x00>"):
        P.piece_trie([P.WORD, "a"], [0, 1], [])


def test_every_node_fails_to_a_shallower_one():
    nodes = np.arange(len(TRIE.failure))
    assert (TRIE.failure[2:] < nodes[2:]).all()
    assert len(TRIE.settled.lengths()) == len(nodes) and (TRIE.settled.lengths()[2:] > 0).all()


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([*IDS.items(), ("a", 9999)], "token STRING, id INT")


def test_codecs_in_spark(spark, vocab):
    rows = spark.createDataFrame(list(enumerate([*GIVEN, None] * 3)), "doc_id LONG, text STRING").repartition(3)
    ids = encode(texts(rows, on_null="drop"), None, SPECIALS, ["doc_id"], codec=P.piece_encoder(vocab, SPECIALS))
    got = {r.doc_id: r.input_ids for r in ids.collect()}
    assert got == {i: by_hand(t) + [1] for i, t in enumerate([*GIVEN, None] * 3) if t is not None}
    back = decode(ids, None, SPECIALS, ["doc_id"], codec=P.piece_decoder(vocab))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t in enumerate([*GIVEN, None] * 3) if t is not None}
    assert "Exchange hash" not in back._jdf.queryExecution().executedPlan().toString()


def test_empty_corpus(spark, vocab):
    rows = spark.createDataFrame([], "doc_id LONG, text STRING")
    codec = P.piece_encoder(vocab, SPECIALS)
    assert encode(texts(rows), None, SPECIALS, ["doc_id"], codec=codec).collect() == []
    assert P.piece_vocabulary(rows, 300).count() == len(FIXED)


def test_blocks_of_pieces_hold_the_stream(spark, vocab):
    docs = [(i, t, "train") for i, t in enumerate(GIVEN * 4)]
    rows = spark.createDataFrame(docs, "doc_id LONG, text STRING, split STRING")
    params = PrepareParams(max_seq_length=6, grouping="global")
    blocks = prepare_corpus(rows, None, SPECIALS, params, P.piece_encoder(vocab, SPECIALS))
    got = [i for r in blocks.orderBy("pos").collect() for i in r.input_ids[1:]]
    stream = [i for _, t, _ in docs for i in by_hand(t) + [1]]
    assert got == stream[: len(stream) // 5 * 5]


def test_executors_need_no_copy_of_the_package(tmp_path):
    job = tmp_path / "codec.pickle"
    arrays = {name: value for name, value in vars(TRIE).items() if name != "settled"}
    lists = (TRIE.settled.flat, TRIE.settled.bounds)

    job.write_bytes(cloudpickle.dumps((P.batch_ids, P.PieceTrie, P.Lists, lists, arrays)))
    code = (
        "import pickle, sys, pyarrow as pa\n"
        "ids, trie, many, lists, arrays = pickle.load(open(sys.argv[1], 'rb'))\n"
        "print(ids(trie(settled=many(*lists), **arrays), pa.array(['abcde'])).to_pylist())\n"
        "assert not any(m.startswith('corpusweave') for m in sys.modules)"
    )
    done = subprocess.run([sys.executable, "-c", code, job], cwd=tmp_path, capture_output=True, text=True, env={"PATH": ""})
    assert done.stdout.strip() == str([by_hand("abcde")]), done.stderr


def test_the_stand_in_vocabulary(spark):
    rows = spark.createDataFrame([("abc abc x\U0001f600",)], "text STRING")
    got = {r.token: r.id for r in P.piece_vocabulary(rows, 400).collect()}
    assert {t: got[t] for t in FIXED} == {t: i for i, t in enumerate(FIXED)}
    rest = sorted(set(got) - set(FIXED), key=got.get)
    assert set(rest[:6]) == {"a", "ab", "abc", "##b", "##bc", "##c"}
    assert set(rest[6:]) == {"x", "x\U0001f600", "##\U0001f600"}
    assert P.piece_vocabulary(rows, 264).count() == 264
