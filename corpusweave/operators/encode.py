"""Encoding documents to token ids against a vocabulary table, and back.

Two forms, of the caller's choice, give the same rows. ``"lookup"`` broadcasts the vocabulary as
two Arrow arrays and looks words up a batch at a time beside the scan, so that no token crosses the
network; it works on streams too, and refuses a vocabulary over ``MAX_VOCABULARY_BYTES``. ``"join"`` takes any
vocabulary: the distinct words of blocks of texts and the vocabulary shuffle on ``(token, salt)``, the salt being taken from the
block, so that a frequent word is spread over many tasks. In both a token that the vocabulary
holds several times has its least id, and rows are told apart by nothing but their text.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.sequences import append_id, ones, prepend_id
from corpusweave.functions.words import required, words
from corpusweave.operators.vocab import invert
from corpusweave.params import Specials
from corpusweave.session import bucketed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

Codec = Callable[[Column], Column]

# Of tokens and ids together, per Python worker.
MAX_VOCABULARY_BYTES = 64 << 20
JOIN_SALTS = 64
FILTER_BITS = 24  # the filter of a vocabulary's tokens has 2^24 bits, 2 MB
BLOCK_BYTES = 4 << 20  # of text whose distinct words are joined once
SLICE_BYTES = 2 << 20  # of texts or ids that are looked up at once; a longer row is a slice of its own
FORMS = ("lookup", "join")


def texts(rows: DataFrame, text_column: str = "text", on_null: str = "fail") -> DataFrame:
    """The text under its standard name, with nulls rejected or dropped."""
    picked = rows.withColumn("text", F.col(text_column).cast("string"))
    if on_null == "drop":
        return picked.where(F.col("text").isNotNull())
    return picked.withColumn("text", required(F.col("text"), text_column))


def token_count(text: Column) -> Column:
    """Tokens a text will have with its EOS, without looking any up."""
    return F.size(words(text)) + 1


def encode(
    docs: DataFrame,
    vocab: DataFrame | None,
    specials: Specials,
    keep: list[str],
    codec: Codec | None = None,
    form: str = "lookup",
) -> DataFrame:
    """Ids of each document's words, closed by EOS, with a mask of ones.

    ``docs`` has ``text``; of its other columns those in ``keep`` stay. No special token is
    added in front and nothing is cut. A ``codec`` takes the place of the vocabulary: a
    function from the text column to its ids, such as an Arrow UDF around a pretrained tokenizer.
    """
    ids = text_ids(docs, vocab, specials, keep, codec, form)
    closed = ids.withColumn("input_ids", append_id(F.col("input_ids"), specials.eos))
    return closed.withColumn("attention_mask", ones(F.col("input_ids")))


def encode_prompts(
    prompts: DataFrame,
    vocab: DataFrame | None,
    specials: Specials,
    keep: list[str],
    codec: Codec | None = None,
    form: str = "lookup",
) -> DataFrame:
    """Ids of each prompt's words behind BOS, as a model is asked to continue it."""
    ids = text_ids(prompts, vocab, specials, keep, codec, form)
    opened = ids.withColumn("input_ids", prepend_id(F.col("input_ids"), specials.bos))
    return opened.withColumn("attention_mask", ones(F.col("input_ids")))


def text_ids(
    docs: DataFrame, vocab: DataFrame | None, specials: Specials, keep: list[str], codec: Codec | None, form: str
) -> DataFrame:
    """``keep`` columns and ``input_ids``, by codec or in one of the two forms."""
    if codec is not None:
        return docs.select(*keep, codec(F.col("text")).alias("input_ids"))
    if vocab is None:
        raise ValueError("encoding needs a vocabulary or a codec")
    if checked_form(form) == "join":
        return word_ids_by_join(docs, vocab, specials, keep)
    return word_ids_by_lookup(docs, vocab, specials, keep)


def checked_form(form: str) -> str:
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    return form


def one_id_per_token(vocab: DataFrame) -> DataFrame:
    """The least id of each token."""
    return vocab.groupBy("token").agg(F.min(F.col("id").cast("int")).alias("id"))


def broadcast_arrays(pairs: DataFrame, limit: int | None = None) -> tuple[pa.Array, pa.Array]:
    """Tokens and ids as Arrow arrays, read up to the bound on their bytes."""
    limit = MAX_VOCABULARY_BYTES if limit is None else limit
    tokens, ids, size = [], [], 0
    for token, token_id in pairs.select("token", "id").toLocalIterator():
        size += len(token.encode()) + 8
        if size > limit:
            raise ValueError(f"the vocabulary is over {limit} bytes: take the form 'join'")
        tokens.append(token)
        ids.append(token_id)
    return pa.array(tokens, pa.string()), pa.array(ids, pa.int32())


def _unknown_id(specials: Specials) -> int:
    if specials.unk is None:
        raise ValueError("encoding against a vocabulary table needs an UNK id")
    return specials.unk


def slice_bounds(batch: pa.Array, size: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text or ids each."""
    lengths = pc.binary_length(batch) if pa.types.is_string(batch.type) else pc.multiply(pc.list_value_length(batch), 4)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.searchsorted(ends, np.arange(size, int(ends[-1]) if len(ends) else 0, size)))
    cuts = [0, *cuts[(cuts > 0) & (cuts < len(batch))].tolist(), len(batch)]
    return list(zip(cuts, cuts[1:]))


def by_slices(batches: Iterator[pa.Array], function: Callable[[pa.Array], pa.Array]) -> Iterator[pa.Array]:
    """``function`` of batches of texts or id lists, a slice at a time, as it holds several times their size.

    What a slice gives goes out before the next one is taken, so a worker holds no batch's results.
    """
    for batch in batches:
        for a, b in slice_bounds(batch, SLICE_BYTES):
            yield function(batch.slice(a, b - a))
        pa.default_memory_pool().release_unused()


def in_slices(batch: pa.Array, function: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """The same of one batch, as one array."""
    return pa.concat_arrays(list(by_slices(iter([batch]), function)))


def word_places(batch: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the bounds of each text among them."""
    for blank in "\t\n\r":
        batch = pc.replace_substring(batch, blank, " ")
    pieces = pc.split_pattern(batch, " ")
    flat = pieces.flatten()
    is_word = pc.not_equal(flat, "")
    words_before = np.concatenate([[0], np.cumsum(is_word.to_numpy(zero_copy_only=False))])
    return flat.filter(is_word), words_before[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]


def word_ids_by_lookup(docs: DataFrame, vocab: DataFrame, specials: Specials, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(broadcast_arrays(one_id_per_token(vocab)))
    unknown = _unknown_id(specials)

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = shared.value

        def ids_of(part: pa.Array) -> pa.Array:
            flat, bounds = word_places(part)
            found = ids.take(pc.index_in(flat, value_set=tokens))
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found.fill_null(unknown))

        return by_slices(batches, ids_of)

    return docs.select(*keep, lookup("text").alias("input_ids"))


def token_filter(vocab: DataFrame) -> np.ndarray:
    """Bits at the hashes of all tokens; it has one size whatever the vocabulary, and a larger one only keeps less out."""
    hashes = vocab.select(F.crc32(F.col("token").cast("binary")).bitwiseAND((1 << FILTER_BITS) - 1).alias("hash"))
    bits = F.bitmap_construct_agg(F.col("hash") % (1 << 15)).alias("bits")
    found = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for part, of_part in hashes.where("hash IS NOT NULL").groupBy(F.shiftright("hash", 15)).agg(bits).toLocalIterator():
        found[part] = np.frombuffer(of_part, np.uint8)
    return found.ravel()


def may_be_token(words_: pa.Array, bits: np.ndarray) -> np.ndarray:
    """False for words that are surely no tokens."""
    codes = (zlib.crc32(w) for w in words_.cast(pa.binary()).to_pylist())
    hashes = np.fromiter(codes, np.int64, len(words_)) & ((1 << FILTER_BITS) - 1)
    return (bits[hashes >> 3] >> (hashes & 7).astype(np.uint8) & 1).astype(bool)


def word_blocks(docs: DataFrame, keep: list[str], vocab: DataFrame | None = None) -> DataFrame:
    """Rows of whole texts as ``block, starts, places, tokens`` and a list of each column to keep.

    ``tokens`` has the distinct words of a block, or those of them that may be in the vocabulary, ``places`` each word of its
    texts as a place among them, and the place behind them for words that surely are not.
    """
    bits = np.full(1 << FILTER_BITS - 3, 255, np.uint8) if vocab is None else token_filter(vocab)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    names = ["block", *[f"kept{i}" for i in range(len(keep))], "starts", "places", "tokens"]

    def one(array: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slice_bounds(batch.column(0), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                flat, bounds = word_places(pc.fill_null(part.column(0), ""))
                known = flat.dictionary_encode()
                maybe = may_be_token(known.dictionary, shared.value)
                place = np.where(maybe, np.cumsum(maybe) - 1, maybe.sum()).astype(np.int32)[known.indices.to_numpy()]
                columns = [*part.columns[1:], pa.array(bounds, pa.int32()), pa.array(place), known.dictionary.filter(maybe)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *map(one, columns)], names)
                number += 1
                pa.default_memory_pool().release_unused()

    rows = docs.select("text", *[F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)])
    kept = "".join(f"kept{i} array<{kind}>, " for i, kind in enumerate(kinds))
    return rows.mapInArrow(run, f"block long, {kept}starts array<int>, places array<int>, tokens array<string>")


def word_ids_by_join(
    docs: DataFrame, vocab: DataFrame, specials: Specials, keep: list[str], salts: int = JOIN_SALTS
) -> DataFrame:
    """Join form for a vocabulary of any size.

    Texts are put in blocks of some ``BLOCK_BYTES``, which are stored in buckets and never move, each with its distinct words: one
    row per block and distinct word that passes the filter of the vocabulary meets it, and its id comes back to the block, so a word
    moves once however often it occurs there.
    """
    blocks, _ = bucketed(word_blocks(docs, keep, vocab), "block")
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    placed = blocks.select("block", salt.alias("salt"), F.posexplode("tokens").alias("place", "token"))
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    salted = one_id_per_token(vocab).select("token", "id", all_salts)
    met = placed.join(salted.hint("merge"), ["token", "salt"]).select("block", F.struct("place", "id").alias("at"))
    found = met.groupBy("block").agg(F.collect_list("at").alias("found"))
    kept = [f"kept{i}" for i in range(len(keep))]
    texts_ = blocks.select("block", *kept, "starts", "places", F.size("tokens").alias("n_tokens"))
    joined = texts_.join(found.hint("shuffle_hash"), "block", "left").select(*kept, "starts", "places", "n_tokens", "found")
    unknown, n_kept = _unknown_id(specials), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                *own, starts, places = (batch.column(i)[row].values for i in range(n_kept + 2))
                ids = np.full(batch.column(n_kept + 2)[row].as_py() + 1, unknown, np.int32)
                if batch.column(n_kept + 3)[row].is_valid:
                    place, known = batch.column(n_kept + 3)[row].values.flatten()
                    ids[place.to_numpy()] = known.to_numpy()
                lists = pa.ListArray.from_arrays(starts, pa.array(ids[places.to_numpy()]))
                yield pa.RecordBatch.from_arrays([*own, lists], [*kept, "input_ids"])

    kinds = "".join(f"kept{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    rows = joined.mapInArrow(run, f"{kinds}input_ids array<int>")
    return rows.select(*[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)], "input_ids")


def decode(
    rows: DataFrame,
    vocab: DataFrame | None,
    specials: Specials,
    keep: list[str],
    codec: Codec | None = None,
    form: str = "lookup",
) -> DataFrame:
    """Text of each ``input_ids``, special ids left out, words joined by one blank.

    Lossy by nature: white space is not restored and unknown words are gone. A row of
    special ids alone gives an empty text. A ``codec`` takes the place of the vocabulary: a function
    from the column of ids, special ones left out, to its text.
    """
    if codec is not None:
        return rows.select(*keep, codec(without(F.col("input_ids"), specials.ids())).alias("text"))
    if vocab is None:
        raise ValueError("decoding needs a vocabulary or a codec")
    if checked_form(form) == "join":
        return decode_by_join(rows, vocab, specials, keep)
    return decode_by_lookup(rows, vocab, specials, keep)


def without(ids: Column, special: list[int]) -> Column:
    return F.filter(ids, lambda i: ~i.isin(special))


def decode_by_lookup(rows: DataFrame, vocab: DataFrame, specials: Specials, keep: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(broadcast_arrays(invert(vocab)))
    special = specials.ids()

    @F.arrow_udf("string")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = shared.value

        def text_of(part: pa.Array) -> pa.Array:
            flat = part.flatten()
            place = pc.index_in(flat, value_set=ids)
            kept = pc.and_(pc.is_valid(place), pc.invert(pc.is_in(flat, value_set=pa.array(special, pa.int32()))))
            kept_before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
            bounds = kept_before[part.offsets.to_numpy() - part.offsets[0].as_py()]
            found = tokens.take(place.filter(kept))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found), " ")

        return by_slices(batches, text_of)

    return rows.select(*keep, lookup("input_ids").alias("text"))


def decode_by_join(
    rows: DataFrame, vocab: DataFrame, specials: Specials, keep: list[str], salts: int = JOIN_SALTS
) -> DataFrame:
    """Join form; texts come back to their rows on a digest of the ids."""
    digest = F.unhex(F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")))
    keyed = rows.select(*keep, digest.alias("ids_key"), "input_ids")
    salt = F.pmod(F.xxhash64("ids_key"), F.lit(salts)).cast("int")
    placed = keyed.select("ids_key", salt.alias("salt"), F.posexplode("input_ids").alias("place", "id"))
    plain = placed.where(~F.col("id").isin(specials.ids()))
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    salted = invert(vocab).select("token", "id", all_salts)
    found = plain.join(salted, ["id", "salt"]).select("ids_key", F.struct("place", "token").alias("at"))
    decoded = found.groupBy("ids_key").agg(F.array_sort(F.collect_set("at")).alias("placed"))
    texts_ = decoded.select("ids_key", F.array_join(F.col("placed.token"), " ").alias("text"))
    kept = keyed.select(*keep, "ids_key").join(texts_.hint("merge"), "ids_key", "left")
    return kept.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
