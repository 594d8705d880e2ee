"""Toxicity scores of whole texts by a recurrent network over overlapping windows.

A text scores as its most toxic window does, so one toxic passage in a long text counts. Training sees
labels of whole texts: of each text the window with the highest logit is trained towards its label,
and windows are chosen anew in each round.

The network is fitted on the driver, on a bounded sample of labelled rows: the ``SAMPLE_TEXTS`` rows that
come first in a hash order of their ids, each with its whole text and all its windows; rows of over ``SAMPLE_CHARS`` code
points are not learned from, which bounds the sample as a whole. The first component of a word's vector is how far its share of toxic texts stands out from
chance; words that do, in at least ``MIN_TEXTS`` texts, and the ``FREQUENT_WORDS`` most frequent ones are
known to the network, all others by their characters only. Labels are taken to be partly wrong: the
loss is the generalised cross-entropy ``(1 - p ** TRUST) / TRUST``, under which a text that stays at odds with
its label counts less and less.

Plan: fitting scans the labels and the ids and texts of the sample; scoring is one scan without a
shuffle, with every window of every text. The model is some 200 KB, whatever the data.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm import gru
from corpusweave.llm.common import crc_fold, give_back, released, shipped, text_or_empty
from corpusweave.llm.trie import slices

FOLDS = 5
SAMPLE_TEXTS = 3000
SAMPLE_CHARS = 20_000
MIN_TEXTS = 3
FREQUENT_WORDS = 500
MAX_WORDS = 20_000
STEPS = 200
ROUNDS = 5
TRUST = 0.7
DECAY = 0.002
BATCH = 64
RATE = 0.01
SEED = 7
SLICE_CHARS = 200_000
KEPT_WORDS = 60_000
WINDOWS_AT_ONCE = 2048


def sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> list[tuple[str, int]]:
    """Whole texts and labels to learn from: a bounded number of rows outside of fold 0, the first in hash order.

    Rows without a label or an id and texts of over ``SAMPLE_CHARS`` code points are left out; of several labels of one
    id the greatest holds.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = known.where(crc_fold(F.col("doc_id"), folds) != 0)
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS)
    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return [(r["text"], r["toxic"]) for r in rows.limit(2 * SAMPLE_TEXTS).collect()]


def standing_out(with_word: np.ndarray, toxic_with_word: np.ndarray, share: float) -> np.ndarray:
    """How far the toxic share of a word's texts is from the overall one, beyond what chance gives the most.

    The signed root of the log-likelihood ratio, less what the largest of as many normal deviates
    comes to; 0 within that.
    """
    n, k = with_word.astype(float), toxic_with_word.astype(float)
    p = np.clip(k / n, 1e-9, 1 - 1e-9)
    gain = k * np.log(p / share) + (n - k) * np.log((1 - p) / (1 - share))
    root = np.sqrt(np.maximum(2 * gain, 0))
    beyond = np.maximum(0, root - np.sqrt(2 * np.log(len(n) + 1)))
    return np.sign(p - share) * np.minimum(beyond / 3, 2)


def fit(rows: list[tuple[str, int]], seed: int = SEED) -> dict:
    """A model from texts and labels; without texts of both labels it only knows their share."""
    texts = [gru.words_of(t) for t, _ in rows]
    toxic = np.array([y for _, y in rows], np.float32)
    share = float((toxic.sum() + 0.5) / (len(toxic) + 2))
    seen = Counter(w for ws in texts for w in set(ws))
    seen_toxic = Counter(w for ws, y in zip(texts, toxic, strict=True) if y for w in set(ws))
    often = sorted((w for w, n in seen.items() if n >= MIN_TEXTS), key=lambda w: (-seen[w], w))
    counts = np.array([seen[w] for w in often]), np.array([seen_toxic[w] for w in often])
    telling = standing_out(*counts, share) if often else np.zeros(0)
    known = [(w, x) for i, (w, x) in enumerate(zip(often, telling, strict=True)) if x or i < FREQUENT_WORDS][:MAX_WORDS]
    params = gru.start(len(known), seed)
    model = {"known": {w: i + 1 for i, (w, _) in enumerate(known)}, "params": params, "share": share, "fitted": False}
    if not 0 < toxic.sum() < len(toxic):
        return model
    if known:
        params["words"][1:, 0] = [x for _, x in known]
    params["out_b"][0] = np.log(share / (1 - share))
    train(params, model["known"], texts, toxic, np.random.default_rng(seed))
    del texts, seen, seen_toxic
    give_back()  # the driver goes on with other work
    return model | {"fitted": True}


def train(
    params: gru.Params, known: dict[bytes, int], texts: list[list[bytes]], toxic: np.ndarray, rng: np.random.Generator
) -> None:
    """Adjusts the parameters in ``ROUNDS`` rounds of about ``STEPS / ROUNDS`` steps, one pass at least."""
    distinct = sorted({w for ws in texts for w in ws})
    number = {w: i for i, w in enumerate(distinct)}
    ids = np.array([known.get(w, 0) for w in distinct], np.int64)
    flat = np.array([number[w] for ws in texts for w in ws], np.int64)
    lengths = np.array([len(ws) for ws in texts], np.int64)
    if not len(flat):
        return
    first, size, text = gru.windows(lengths)
    buckets, starts = gru.trigrams(distinct)
    per_word = np.diff(np.append(starts, len(buckets)))
    moments: dict[str, list[np.ndarray]] = {}
    step = 0
    passes = max(1, -(-STEPS * BATCH // (ROUNDS * len(texts))))
    for _ in range(ROUNDS):
        projected = gru.project(params, gru.embed(params, distinct, ids))
        parts = [slice(i, i + WINDOWS_AT_ONCE) for i in range(0, len(first), WINDOWS_AT_ONCE)]
        logits = np.concatenate([_logits(params, projected, flat, first[p], size[p]) for p in parts])
        by_logit = np.lexsort((logits, text))
        last = np.append(np.flatnonzero(np.diff(text[by_logit])), len(text) - 1)
        best = np.concatenate([rng.permutation(by_logit[last]) for _ in range(passes)])
        for i in range(0, len(best), BATCH):
            part = best[i : i + BATCH]
            at, mask = gru.places(first[part], size[part], flat)
            used, local = np.unique(at, return_inverse=True)
            local = local.reshape(at.shape)
            vectors = gru.embed(params, [distinct[j] for j in used], ids[used])
            keep: list = []
            found = gru.forward(params, gru.project(params, vectors), local, mask, keep)
            p, y = gru.sigmoid(found), toxic[text[part]]
            of_logit = ((p - y) * np.where(y > 0, p, 1 - p) ** TRUST / len(part)).astype(np.float32)
            grads, of_vectors = gru.backward(params, vectors, local, mask, keep, of_logit)
            grads["words"] = np.zeros_like(params["words"])
            np.add.at(grads["words"], ids[used], of_vectors[:, : gru.WORD_DIM])
            grads["words"][0] = 0
            grads["chars"] = np.zeros_like(params["chars"])
            of_chars = of_vectors[:, gru.WORD_DIM :] / per_word[used][:, None]
            spans = [slice(starts[j], starts[j] + per_word[j]) for j in used]
            trigrams = np.concatenate([buckets[s] for s in spans])
            np.add.at(grads["chars"], trigrams, np.repeat(of_chars, per_word[used], axis=0))
            step += 1
            _adam(params, grads, moments, step)


def _adam(params: gru.Params, grads: gru.Params, moments: dict[str, list[np.ndarray]], step: int) -> None:
    norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
    for name, grad in grads.items():
        grad = grad / max(1.0, norm / 5)
        mean, square = moments.setdefault(name, [np.zeros_like(params[name]), np.zeros_like(params[name])])
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad**2 - square)
        rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        if name in ("words", "chars"):
            held = params[name][:, :1].copy()
            params[name] *= 1 - DECAY
            if name == "words":
                params[name][:, :1] = held
        params[name] -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)


def _logits(
    params: gru.Params, projected: dict[str, np.ndarray], flat: np.ndarray, first: np.ndarray, size: np.ndarray
) -> np.ndarray:
    at, mask = gru.places(first, size, flat)
    return gru.forward(params, projected, at, mask)


class Scorer:
    """A fitted model with the projected vectors of words it has met, up to ``KEPT_WORDS``."""

    def __init__(self, model: dict):
        self.known, self.params = model["known"], model["params"]
        self.share, self.fitted = model["share"], model["fitted"]
        self.start_anew()

    def start_anew(self) -> None:
        self.places: dict[bytes, int] = {}
        self.projected = gru.project(self.params, np.zeros((0, gru.WORD_DIM + gru.CHAR_DIM), np.float32))

    def learn(self, words: set[bytes]) -> None:
        new = sorted(words.difference(self.places))
        if not new:
            return
        ids = np.array([self.known.get(w, 0) for w in new], np.int64)
        more = gru.project(self.params, gru.embed(self.params, new, ids))
        self.projected = {side: np.concatenate([rows, more[side]]) for side, rows in self.projected.items()}
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of windows of each text; a text without words scores the share of toxic texts."""
        words = [gru.words_of(t) for t in texts]
        lengths = np.array([len(ws) for ws in words], np.int64)
        first, size, text = gru.windows(lengths)
        per_text = np.bincount(text, minlength=len(texts))
        if not self.fitted or not len(text):
            return np.full(len(texts), self.share), per_text
        if len(self.places) > KEPT_WORDS:
            self.start_anew()
        self.learn({w for ws in words for w in ws})
        flat = np.fromiter((self.places[w] for ws in words for w in ws), np.int64, int(lengths.sum()))
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(first), WINDOWS_AT_ONCE):
            part = slice(i, i + WINDOWS_AT_ONCE)
            np.maximum.at(best, text[part], _logits(self.params, self.projected, flat, first[part], size[part]))
        return np.where(per_text > 0, gru.sigmoid(best), self.share), per_text


def score_toxicity(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``n_windows`` of each whole text.

    A null or empty text has no windows and scores the share of toxic texts in the sample. Repeated
    rows score alike. Columns of ``keep`` that have the name of an added one are left out.
    """
    spark = shipped(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("score", "predicted", "n_windows")]
    rows = docs.select(*dict.fromkeys([*kept, text]))
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
            for first, end in slices(lengths, SLICE_CHARS):
                part = batch.slice(first, end - first)
                score, n = scorer.scores([t or "" for t in part.column(place).to_pylist()])
                predicted = pa.array((score >= 0.5).astype(np.int32))
                added = [pa.array(score, pa.float64()), predicted, pa.array(n, pa.int64())]
                own = part.columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*own, *added], [*kept, "score", "predicted", "n_windows"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(kept)])
    return rows.mapInArrow(lambda batches: released(run(batches)), f"{fields}score double, predicted int, n_windows long")
