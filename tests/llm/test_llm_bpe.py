import random

import public_tokenizers
import pytest
from cases import empty_table, odd_rows, odd_table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusweave.llm.bpe import WordBpe, decode_bpe, encode_bpe, load, symbols
from corpusweave.llm.trie import shared_length, slices, walk

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return WordBpe.from_file(PATH)


def test_rows_equal_the_library(spark, reference):
    model = load(spark, PATH)
    docs = odd_table(spark, clashes=True)
    rows = decode_bpe(encode_bpe(docs, model), model).collect()
    assert len(rows) == len(odd_rows())
    for row in rows:
        ids = reference.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["input_ids"] == ids
        assert row["decoded"] == reference.decode(ids, skip_special_tokens=False)
    both = encode_bpe(docs, model, decoded="decoded")
    assert sorted(both.columns) == sorted([*docs.columns])
    assert sorted((str(r["doc_id"]), r["input_ids"], r["decoded"]) for r in both.collect()) == sorted(
        (str(r["doc_id"]), r["input_ids"], r["decoded"]) for r in rows
    )
    assert encode_bpe(empty_table(spark), model).collect() == []


def test_random_words_equal_the_library(reference, own):
    rng = random.Random(5)
    pieces = [t.replace("</w>", "") for t in own.vocab]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(800)]
    texts += ["".join(rng.choice("etaoin shrdluéßñ'12") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    texts += ["<|endoftext|>a<|startoftext|> b", "don't I'LL we've", "a" * 3000, "ΣΑΣ Σ", "", "😀👍🏽"]
    flat, offsets = own.encode(texts)
    for i, text in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_known_words_may_start_anew(own, monkeypatch, reference):
    monkeypatch.setattr("corpusweave.llm.bpe.KEPT_WORDS", 5)
    small = WordBpe.from_file(PATH)
    for text in ("the quick brown fox jumps over", "the lazy dog sleeps all day long", "the quick dog"):
        assert small.encode([text])[0].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_trie_computes_each_node_once():
    seen = []
    found = {w: list(s) for w, s in walk(["abc", "abd", "ab", "b", "abc"], 0, lambda w, n, s: seen.append(w[:n]) or s[n - 1] + 1)}
    assert sorted(seen) == ["a", "ab", "abc", "abd", "b"]
    assert found["abd"] == [0, 1, 2, 3]
    assert shared_length("abc", "abd") == 2


def test_slices_cover_everything():
    assert list(slices([5, 1, 1, 9, 0, 1], 6)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(slices([], 6)) == []


def test_ids_out_of_the_vocabulary_and_null_lists_decode_to_nothing(spark):
    rows = spark.createDataFrame([([0, -1, 99_999_999, 1],), (None,), ([],)], "input_ids array<int>")
    found = [r[0] for r in decode_bpe(rows, load(spark, PATH)).select("decoded").collect()]
    assert found == ["! \"", "", ""]


def test_symbols_are_reversible():
    assert symbols("abc") == "abc"
    assert len(symbols("é\x00 ")) == 4


def test_plan_has_no_exchange(spark):
    model = load(spark, PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = encode_bpe(docs, model).select(F.size("input_ids"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
