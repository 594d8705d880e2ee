"""Language-model scores by a hashed maximum-entropy model, beside those of smoothed counts.

Tokens are words in lower-case ASCII letters, then one end per text. The model predicts one of ``KNOWN``
tokens (the end, the most frequent words of the training texts, and one stand-in for all others) from the two
before it, in two steps: the class of the token, then the token inside its class, each by a softmax over
sums of weights. Features of a step are the previous token, the one before it (a skip), and both
together; their weights lie in tables of fixed size, found by hash where there are more features than rows.
All other words, of any number, lie in ``KNOWN`` groups by a hash. Where the model predicts the stand-in, a second model
of the same form predicts the word's group from the token before, by its id and, if it is no known one, its group; inside the group
the word has its own smoothed share, from its exact count. So every word has a probability that depends on what is
before it, and in each context those of all words, with one unseen word for each group, add up to 1.

Training is by distributed gradient updates: the gradient of all training tokens is worked out in
parallel over the table of distinct three-token sequences and their counts (of the token before and the group, at most
``KNOWN * 2 * KNOWN`` of them, for the second model), added up by piece of the weights,
and each weight moves by its gradient over what was observed of it, for ``ROUNDS`` rounds.

Plan: the scan puts texts into blocks of some ``BLOCK_CHARS`` characters, each with its distinct words, which lie in buckets and never
move again; one row per block and distinct word moves to be counted and to fetch the count, so a frequent word is one row per
block however often it occurs. Counts and sequences cover all training texts and grow with them; the models
(3.4 MB each) and the known words do not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import block_by_block, bucketed, crc_fold, released, shipped, stored, text_or_empty
from corpusweave.llm.trie import Numbering, slices

FOLDS = 10
SMOOTHING = 0.1
ID_BITS = 10
KNOWN = 1 << ID_BITS
CLASS_BITS = 5
IN_CLASS = 1 << CLASS_BITS
CLASSES = KNOWN // IN_CLASS
END, OTHER = 0, 1
OF_GROUPS = 1 << 3 * ID_BITS
PAIR_ROWS = 8192
TOKEN_ROWS = 16384
ROUNDS = 6
DAMPING = 4.0
BLOCK_CHARS = 8_000_000
PIECE = 8192
ROWS_PER_TASK = 1_500_000
AT_ONCE = 1 << 15

CLASS_SHAPE = (2 * KNOWN + PAIR_ROWS, CLASSES)
TOKEN_SHAPE = (TOKEN_ROWS, IN_CLASS)
N_WEIGHTS = CLASS_SHAPE[0] * CLASS_SHAPE[1] + TOKEN_SHAPE[0] * TOKEN_SHAPE[1]


def tokens_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, the texts' tokens as places among them, and the number of tokens of each text.

    The end is the empty word, at place 0.
    """
    places = Numbering({b"": 0})
    words = (t.encode("utf-8", "surrogatepass").lower().split() for t in texts)
    flat = [np.array([*map(places.__getitem__, ws), 0], np.int32) for ws in words]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    return list(places), np.concatenate([np.zeros(0, np.int32), *flat]), sizes


def groups_of(words: list[str]) -> np.ndarray:
    """The group of each word, of which only those outside of the known ones make use."""
    codes = (zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words)
    return (np.fromiter(codes, np.int64, len(words)) & (KNOWN - 1)).astype(np.int16)


def text_blocks(docs: DataFrame, folds: int = FOLDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of whole texts as ``block, keys, held_out, sizes, tokens, words, in_training, groups``.

    ``groups`` has the group of each distinct word, ``in_training`` counts each distinct word over the block's training texts.
    """
    rows = docs.select(F.col(key), crc_fold(F.col(key), folds).alias("fold"), text_or_empty(text).alias("text"))
    names = ["block", "keys", "held_out", "sizes", "tokens", "words", "in_training", "groups"]

    def one(array: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).to_pylist()
            for first, end in slices(lengths, BLOCK_CHARS):
                part = batch.slice(first, end - first)
                held_out = part.column(1).to_numpy() == 0
                words, tokens, sizes = tokens_of(part.column(2).to_pylist())
                counts = np.bincount(tokens[~np.repeat(held_out, sizes)], minlength=len(words))
                words = [w.decode("utf-8", "surrogatepass") for w in words]
                columns = [
                    part.column(0),
                    pa.array(held_out),
                    pa.array(sizes, pa.int32()),
                    pa.array(tokens),
                    pa.array(words, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(groups_of(words)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *map(one, columns)], names)
                number += 1

    kind = rows.schema[key].dataType.simpleString()
    texts = f"keys array<{kind}>, held_out array<boolean>, sizes array<int>, tokens array<int>"
    return rows.mapInArrow(lambda batches: released(run(batches)), f"block long, {texts}, words array<string>, in_training array<long>, groups array<short>")


def token_counts(blocks: DataFrame) -> DataFrame:
    """``word`` and ``count`` over the training texts, of words that occur there."""
    each = blocks.select(F.inline(F.arrays_zip("words", "in_training")).alias("word", "n")).where("n > 0")
    return each.groupBy("word").agg(F.sum("n").alias("count"))


@dataclass
class Vocabulary:
    """Ids and counts of the known tokens, the totals of all, and occurrences and distinct words of each group of the others."""

    known: dict[str, int]
    counts: np.ndarray
    n: int
    v: int
    group_n: np.ndarray
    group_v: np.ndarray

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of tokens with these counts."""
        return np.log10((count + SMOOTHING) / (self.n + SMOOTHING * (self.v + 1)))

    def in_group(self, count: np.ndarray, group: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of words with these counts among those of their groups."""
        return np.log10((count + SMOOTHING) / (self.group_n[group] + SMOOTHING * (self.group_v[group] + 1)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, ties in the order of their code points, and the groups of all others; a fixed number of rows."""
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.where("word = ''").first()
    rows = counts.where("word <> ''").orderBy(F.desc("count"), "word").limit(KNOWN - 2).collect()
    own = np.zeros(KNOWN, np.int64)
    own[END] = ends["count"] if ends else 0
    own[2 : 2 + len(rows)] = [r["count"] for r in rows]
    own[OTHER] = total["n"] - own.sum()
    group = F.crc32(F.col("word").cast("binary")).bitwiseAND(KNOWN - 1).cast("int").alias("group")
    in_groups = counts.where("word <> ''").groupBy(group).agg(F.sum("count").alias("n"), F.count("*").alias("v"))
    group_n, group_v = np.zeros(KNOWN, np.int64), np.zeros(KNOWN, np.int64)
    for r in in_groups.collect():
        group_n[r["group"]], group_v[r["group"]] = r["n"], r["v"]
    of_known = groups_of([r["word"] for r in rows])
    np.subtract.at(group_n, of_known, own[2 : 2 + len(rows)])
    np.subtract.at(group_v, of_known, 1)
    known = {"": END} | {r["word"]: i + 2 for i, r in enumerate(rows)}
    return Vocabulary(known, own, total["n"], total["v"], group_n, group_v)


def known_ids(known: dict[str, int], words: list[str]) -> np.ndarray:
    return np.fromiter((known.get(w, OTHER) for w in words), np.int64, len(words))


def sequences(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token with the two before it, as one number; a text begins after ends."""
    begins = np.cumsum(sizes) - sizes
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    one[begins] = two[begins] = END
    two[begins[sizes > 1] + 1] = END
    return (two << 2 * ID_BITS) | (one << ID_BITS) | ids


def group_sequences(ids: np.ndarray, groups: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The group of each token with the token before it, by its id and, where that is no known one, its group."""
    begins = np.cumsum(sizes) - sizes
    one, its_group = np.roll(ids, 1), np.roll(groups.astype(np.int64), 1)
    one[begins] = END
    return (np.where(one == OTHER, its_group, 0) << 2 * ID_BITS) | (one << ID_BITS) | groups


def sequence_counts(blocks: DataFrame, shared: Broadcast) -> DataFrame:
    """``sequence`` and ``n`` over the training texts; those of groups lie above ``OF_GROUPS``."""
    columns = ["held_out", "sizes", "tokens", "words", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            for row in range(batch.num_rows):
                held_out, sizes, tokens, words, groups = (batch.column(name)[row].values for name in columns)
                sizes, tokens = sizes.to_numpy().astype(np.int64), tokens.to_numpy()
                ids = known_ids(known, words.to_pylist())[tokens]
                training = ~np.repeat(held_out.to_numpy(zero_copy_only=False), sizes)
                for above in (0, OF_GROUPS):
                    if above:
                        found = above + group_sequences(ids, groups.to_numpy()[tokens], sizes)[training & (ids == OTHER)]
                    else:
                        found = sequences(ids, sizes)[training]
                    values, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], ["sequence", "n"])

    each = block_by_block(blocks.select("block", *columns), run, "sequence long, n long", "block")
    return each.groupBy("sequence").agg(F.sum("n").alias("n"))


class Model:
    """Weights of the two steps, with fixed starting points from the counts of the known tokens."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray):
        self.weights = weights
        split = CLASS_SHAPE[0] * CLASS_SHAPE[1]
        self.of_classes, self.of_tokens = weights[:split].reshape(CLASS_SHAPE), weights[split:].reshape(TOKEN_SHAPE)
        by_class = (counts + SMOOTHING).reshape(CLASSES, IN_CLASS)
        self.class_start = np.log(by_class.sum(axis=1)).astype(np.float32)
        self.token_start = np.log(by_class).astype(np.float32)

    @staticmethod
    def class_rows(context: np.ndarray) -> list[np.ndarray]:
        """Rows of the features of a context: previous token, skip, both."""
        one, two = context & (KNOWN - 1), context >> ID_BITS
        both = (context * 0x9E3779B1 >> 7) % PAIR_ROWS
        return [one, KNOWN + two, 2 * KNOWN + both]

    @classmethod
    def token_rows(cls, context_class: np.ndarray) -> list[np.ndarray]:
        """Rows of the same features joined with a class, by hash."""
        of = context_class & (CLASSES - 1)
        rows = cls.class_rows(context_class >> CLASS_BITS)
        return [((row * CLASSES + of) * 0x85EBCA6B >> 11) % TOKEN_ROWS for row in rows]

    @staticmethod
    def _log_softmax(logits: np.ndarray) -> np.ndarray:
        logits = logits - logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def class_logs(self, context: np.ndarray) -> np.ndarray:
        return self._log_softmax(self.class_start + sum(self.of_classes[r] for r in self.class_rows(context)))

    def token_logs(self, context_class: np.ndarray) -> np.ndarray:
        start = self.token_start[context_class & (CLASSES - 1)]
        return self._log_softmax(start + sum(self.of_tokens[r] for r in self.token_rows(context_class)))

    def log10(self, distinct: np.ndarray) -> np.ndarray:
        """log10 probability of the last token of each of sorted distinct sequences."""
        found = np.empty(len(distinct))
        for first in range(0, len(distinct), AT_ONCE):
            part = distinct[first : first + AT_ONCE]
            contexts, at = np.unique(part >> ID_BITS, return_inverse=True)
            pairs, at_pair = np.unique(part >> CLASS_BITS, return_inverse=True)
            logs = self.class_logs(contexts)[at, (part >> CLASS_BITS) & (CLASSES - 1)]
            found[first : first + AT_ONCE] = logs + self.token_logs(pairs)[at_pair, part & (IN_CLASS - 1)]
        return found / np.log(10)

    def gradient(self, distinct: np.ndarray, n: np.ndarray, with_observed: bool = True) -> list[np.ndarray]:
        """Observed less expected counts of each weight, and the observed ones if asked for."""
        sums = [np.zeros(N_WEIGHTS) for _ in range(1 + with_observed)]
        for first in range(0, len(distinct), AT_ONCE):
            part, weight = distinct[first : first + AT_ONCE], n[first : first + AT_ONCE].astype(float)
            contexts, at = np.unique(part >> ID_BITS, return_inverse=True)
            pairs, at_pair = np.unique(part >> CLASS_BITS, return_inverse=True)
            of_class, split = (part >> CLASS_BITS) & (CLASSES - 1), CLASS_SHAPE[0] * CLASS_SHAPE[1]
            steps = (
                (contexts, at, of_class, self.class_logs, self.class_rows, 0, CLASS_SHAPE),
                (pairs, at_pair, part & (IN_CLASS - 1), self.token_logs, self.token_rows, split, TOKEN_SHAPE),
            )
            for keys, place, outcome, logs, rows_of, offset, shape in steps:
                width = shape[1]
                seen = np.bincount(place * width + outcome, weight, len(keys) * width).reshape(-1, width)
                error = seen - seen.sum(axis=1, keepdims=True) * np.exp(logs(keys))
                for rows in rows_of(keys):
                    order = np.argsort(rows, kind="stable")
                    starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
                    into = slice(offset, offset + shape[0] * width)
                    own = rows[order][starts]
                    for total, part_of in zip(sums, (error, seen), strict=False):
                        total[into].reshape(shape)[own] += np.add.reduceat(part_of[order], starts, axis=0)
        return sums


def summed_gradient(table: DataFrame, shared: Broadcast, with_observed: bool = True) -> list[np.ndarray]:
    """The gradient over the whole table: one per task, added up by piece of the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = shared.value
        parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
        if not parts:
            return
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.argsort(rows[0])]
        sums = np.stack(Model(counts, weights).gradient(rows[0], rows[1], with_observed)).astype(np.float32)
        pieces = [sums[:, i : i + PIECE] for i in range(0, N_WEIGHTS, PIECE)]
        used = [i for i, p in enumerate(pieces) if p.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([pieces[i].tobytes() for i in used], pa.binary())], ["piece", "sums"]
        )

    def add(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = None, None
        for batch in pieces:
            for number, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(sums, np.float32).astype(np.float64)
                total, piece = own if total is None else total + own, number
        sums = total.astype(np.float32).tobytes()
        columns = [pa.array([piece], pa.int32()), pa.array([sums], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "sums"])

    partial = table.select("sequence", "n").mapInArrow(lambda batches: released(run(batches)), "piece int, sums binary")
    whole = [np.zeros(N_WEIGHTS) for _ in range(1 + with_observed)]
    for row in partial.groupBy("piece").applyInArrow(add, "piece int, sums binary").toLocalIterator():
        sums = np.frombuffer(row["sums"], np.float32).reshape(len(whole), -1)
        for total, own in zip(whole, sums, strict=True):
            total[row["piece"] * PIECE :][: len(own)] = own
    return whole


def train(table: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` gradient updates over the table of sequences."""
    context = table.sparkSession.sparkContext
    weights = np.zeros(N_WEIGHTS, np.float32)
    rows = table.count()
    dealt = table.coalesce(max(1, -(-rows // ROWS_PER_TASK)))
    observed = None
    for _ in range(rounds if rows else 0):
        shared = context.broadcast((counts, weights))
        gradient, *first = summed_gradient(dealt, shared, with_observed=observed is None)
        observed = first[0] if first else observed
        shared.unpersist()
        # Three features share each step, so each takes a third of the way.
        weights = (weights + (gradient - DAMPING / 10 * weights) / (3 * (observed + DAMPING))).astype(np.float32)
    return weights


def word_facts(blocks: DataFrame, counts: DataFrame, known: dict[str, int]) -> DataFrame:
    """``block, found, counts``: place and id, as one number, and count of its words that occur in the training texts."""
    ids = blocks.sparkSession.createDataFrame(list(known.items()), "word string, id int")
    facts = counts.join(F.broadcast(ids), "word", "left")  # KNOWN - 1 rows
    facts = facts.select("word", "count", F.coalesce("id", F.lit(OTHER)).alias("id"))
    each = blocks.select("block", F.posexplode("words").alias("place", "word"))
    fetched = each.join(facts.hint("shuffle_hash"), "word")
    found = (F.shiftleft(F.col("place").cast("long"), ID_BITS) + F.col("id")).alias("found")
    # Two lists of numbers, filled row by row in one order: they take half of what a list of structs takes.
    lists = F.collect_list("found").alias("found"), F.collect_list("count").alias("counts")
    return fetched.select("block", found, "count").groupBy("block").agg(*lists)


def score_texts(
    docs: DataFrame, folds: int = FOLDS, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each whole text.

    Rows of fold 0 are held out of all counts and of training. Null and empty texts have one token, the
    end; a null key counts as empty text in the fold; repeated rows count and score each. Without
    training texts every token has the share 1 of the smoothed counts.
    """
    spark = shipped(docs.sparkSession)
    blocks, _ = bucketed(text_blocks(docs, folds, key, text), "block")
    counts = stored(token_counts(blocks), "counts")
    vocab = vocabulary(counts)
    table = stored(sequence_counts(blocks, spark.sparkContext.broadcast((vocab.known,))), "sequences")
    weights = train(table.where(F.col("sequence") < OF_GROUPS), vocab.counts, rounds)
    of_groups = table.where(F.col("sequence") >= OF_GROUPS).withColumn("sequence", F.col("sequence") - OF_GROUPS)
    group_weights = train(of_groups, vocab.group_n, rounds)
    totals = (vocab.counts, vocab.n, vocab.v, vocab.group_n, vocab.group_v)
    shared = spark.sparkContext.broadcast((totals, weights, group_weights))
    found = word_facts(blocks, counts, vocab.known)
    of_texts = ["block", "keys", "held_out", "sizes", "tokens", "groups"]
    texts = blocks.select(*of_texts)
    joined = texts.join(found.hint("shuffle_hash"), "block", "left")
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, (weights, group_weights) = Vocabulary({}, *shared.value[0]), shared.value[1:]
        model, group_model = Model(vocab.counts, weights), Model(vocab.group_n, group_weights)
        for batch in batches:
            for row in range(batch.num_rows):
                keys, held_out, sizes, tokens, groups = (batch.column(name)[row].values for name in of_texts[1:])
                groups = groups.to_numpy()
                count = np.zeros(len(groups), np.int64)
                ids = np.full(len(count), OTHER)
                if batch.column("found")[row].is_valid:
                    found, n_word = (batch.column(name)[row].values.to_numpy() for name in ("found", "counts"))
                    count[found >> ID_BITS], ids[found >> ID_BITS] = n_word, found & (KNOWN - 1)
                ids[0] = END
                sizes, tokens = sizes.to_numpy().astype(np.int64), tokens.to_numpy()
                distinct, at = np.unique(sequences(ids[tokens], sizes), return_inverse=True)
                logs = model.log10(distinct)[at]
                other = ids[tokens] == OTHER
                distinct, at = np.unique(group_sequences(ids[tokens], groups[tokens], sizes)[other], return_inverse=True)
                logs[other] += group_model.log10(distinct)[at] + vocab.in_group(count, groups)[tokens[other]]
                begins = np.cumsum(sizes) - sizes
                columns = [
                    keys,
                    held_out,
                    pa.array(sizes),
                    pa.array(np.add.reduceat((count > 0)[tokens].astype(np.int64), begins)),
                    pa.array(np.full(len(sizes), vocab.n, np.int64)),
                    pa.array(np.add.reduceat(vocab.base(count)[tokens], begins)),
                    pa.array(np.add.reduceat(logs, begins)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    counts_of = "held_out boolean, n_tokens long, n_known long, train_tokens long"
    return block_by_block(joined, run, f"`{key}` {kind}, {counts_of}, base_score double, score double", "block")
