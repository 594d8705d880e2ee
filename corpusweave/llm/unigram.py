"""Token counts of texts under a unigram model, by dynamic programming shared over a trie.

A pre-token's forward score is the best sum of log probabilities over all ways to cut it into
tokens. The score of a prefix holds for every pre-token that starts with it, so distinct
pre-tokens are put into a trie and each node's score, with the number of tokens on the best
way, is computed once; the entry of a terminal node is the count of its pre-token.

Model: tokens of a public vocabulary, with probabilities by the Zipf-Mandelbrot law
``p(rank) ~ 1 / (rank + ZIPF_SHIFT)`` over the order in which the vocabulary lists them; the 256
single bytes rank last, so any text can be cut. Among ways of equal score the one of fewer
tokens counts, then the one whose last token is longer.

Plan: one scan, no shuffle; a task holds a slice of texts and a bounded memory of pre-tokens.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from corpusweave.llm.bpe import ALPHABET, MAX_VOCABULARY, symbols
from corpusweave.llm.common import released, shipped
from corpusweave.llm.trie import numbered, slices, walk

# The pattern that byte-level vocabularies split text by (fixed value).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ZIPF_SHIFT = 2.7
SLICE_CHARS = 1_000_000
KEPT_WORDS = 400_000

State = tuple[float, int]


@dataclass
class Unigram:
    """Log probabilities of tokens written in the byte alphabet."""

    scores: dict[str, float]

    @classmethod
    def from_file(cls, path: str, shift: float = ZIPF_SHIFT) -> Unigram:
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        if len(vocab) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(vocab)} tokens is too large to broadcast")
        single = set(ALPHABET)
        listed = [t for t, _ in sorted(vocab.items(), key=lambda item: item[1]) if t not in single]
        weights = 1.0 / (np.arange(len(listed) + len(ALPHABET)) + shift)
        logs = np.log(weights / weights.sum())
        return cls(dict(zip([*listed, *ALPHABET], logs.tolist(), strict=True)))

    def __getstate__(self):
        return {"scores": self.scores}

    @cached_property
    def _longest(self) -> int:
        return max(map(len, self.scores))

    @cached_property
    def _lengths(self) -> dict[str, list[int]]:
        """By their last three symbols (of shorter ones: all), how many symbols tokens have, most first."""
        found: dict[str, set[int]] = {}
        for token in self.scores:
            found.setdefault(token[-3:], set()).add(len(token))
        return {tail: sorted(sizes, reverse=True) for tail, sizes in found.items()}

    @cached_property
    def _pattern(self) -> regex.Pattern:
        return regex.compile(PRETOKENS)

    @cached_property
    def _known(self) -> dict[str, State]:
        """States of pre-tokens met since the memory last turned."""
        return {}

    @cached_property
    def _before(self) -> dict[str, State]:
        """States of those met in the turn before."""
        return {}

    def pretokens(self, text: str) -> list[str]:
        return self._pattern.findall(text)

    def forward(self, word: str, length: int, states: list[State]) -> State:
        """Best score and, negated, the number of tokens of ``word[:length]``."""
        scores = self.scores
        last = word[length - 1 : length]
        score, count = states[length - 1]
        best = (score + scores[last], count - 1)
        sizes = self._lengths.get(word[length - 3 : length], ()) if length > 2 else ()
        for size in (*sizes, 2) if length > 1 else ():
            if size <= length:
                own = scores.get(word[length - size : length])
                if own is not None:
                    score, count = states[length - size]
                    way = (score + own, count - 1)
                    if way > best:
                        best = way
        return best

    def count_pretokens(self, words: set[str]) -> None:
        """Brings the states of the pre-tokens into ``_known``.

        A memory of ``KEPT_WORDS`` in two halves: when ``_known`` is full it takes the place of ``_before``, from where what
        is met again comes back. So frequent pre-tokens stay and rare ones go, which costs time only.
        """
        if len(self._known) > KEPT_WORDS // 2:
            self._before, self._known = self._known, {}
        known, before = self._known, self._before
        by_symbols = {}
        for word in words:
            if word not in known:
                state = before.get(word)
                if state is None:
                    by_symbols[symbols(word)] = word
                else:
                    known[word] = state
        for spelled, states in walk(by_symbols, (0.0, 0), self.forward):
            known[by_symbols[spelled]] = states[len(spelled)]

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """Pre-tokens, tokens and log10 probability of each text."""
        words, places, counts = numbered(map(self.pretokens, texts))
        self.count_pretokens(set(words))
        known = [self._known[w] for w in words]
        scores = np.array([s for s, _ in known], np.float64)[places]
        tokens = np.array([-n for _, n in known], np.int64)[places]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        parts = [slice(*pair) for pair in pairwise(bounds)]
        return [(len(tokens[p]), int(tokens[p].sum()), float(scores[p].sum()) / math.log(10)) for p in parts]


def load(spark: SparkSession, path: str) -> Broadcast:
    return shipped(spark).sparkContext.broadcast(Unigram.from_file(path))


def count_tokens(docs: DataFrame, model: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_pretokens``, ``n_tokens`` and ``log10_prob`` of each whole text, one row per input row.

    A null or empty text has no tokens and the probability 1. Repeated rows are counted each, a null
    key stays, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model.value
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for first, end in slices(lengths, SLICE_CHARS):
                part = batch.slice(first, end - first)
                rows = unigram.count([t or "" for t in part.column(1).to_pylist()])
                pretokens, tokens, logs = zip(*rows, strict=True)
                columns = [pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64()), pa.array(logs, pa.float64())]
                names = [key, "n_pretokens", "n_tokens", "log10_prob"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(lambda batches: released(run(batches)), f"`{key}` {kind}, n_pretokens long, n_tokens long, log10_prob double")
