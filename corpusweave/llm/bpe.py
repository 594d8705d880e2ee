"""BPE encoding by a walk of the trie of distinct words, and decoding.

The state of a prefix is the last token of its encoding. A token ``t`` that ends a prefix is its
last token exactly if merging the last token of the prefix before ``t`` together with ``t`` leaves the
two apart, so the state of a trie node follows from the states on its path, and the encoding of a
prefix that many words share is found once. Reading the last tokens backwards from a word's
end gives all its tokens.

Plan: one scan, no shuffle. A task holds the words of a slice of texts (``SLICE_CHARS``) and a
bounded memory of encoded words (``KEPT_WORDS``), of which those that several slices used stay when it is full. The vocabulary is a file of a public tokenizer,
read on the driver and broadcast; its size does not depend on the data and is checked.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.llm.common import released, shipped
from corpusweave.llm.trie import numbered, slices, walk

MAX_VOCABULARY = 1_000_000
SLICE_CHARS = 500_000
KEPT_WORDS = 240_000
KEPT_PAIRS = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


ALPHABET = byte_alphabet()
_BYTES_TO_SYMBOLS = {i: c for i, c in enumerate(ALPHABET)}


def symbols(word: str) -> str:
    """A word with each of its UTF-8 bytes as one printable character."""
    if word.isascii():
        if word.isprintable() and " " not in word:
            return word
    return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTES_TO_SYMBOLS)


@dataclass
class WordBpe:
    """Vocabulary, merges and word rule of one tokenizer file."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]
    suffix: str
    pattern: str

    @classmethod
    def from_file(cls, path: str) -> WordBpe:
        """Reads a tokenizer that normalizes by NFC and lower case and splits words by a pattern."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if len(model["vocab"]) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(model['vocab'])} tokens is too large to broadcast")
        steps = {n["type"] for n in spec["normalizer"]["normalizers"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if model["type"] != "BPE" or steps != {"NFC", "Replace", "Lowercase"} or not split["invert"] or spec["decoder"]:
            raise ValueError(f"{path}: not a word BPE tokenizer without a decoder")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The white space of the file's patterns is the Unicode property, which leaves U+001C to U+001F out.
        pattern = split["pattern"]["Regex"].replace("[^\\s", "[^\\p{White_Space}")
        suffix = model["end_of_word_suffix"] or ""
        return cls(model["vocab"], [tuple(m) for m in model["merges"]], special, suffix, pattern)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("vocab", "merges", "special", "suffix", "pattern")}

    @cached_property
    def tokens(self) -> list[str]:
        """Token strings by id."""
        by_id = {i: t for t, i in (self.vocab | self.special).items()}
        return [by_id.get(i, "") for i in range(max(by_id) + 1)]

    @cached_property
    def _ranks(self) -> dict[tuple[str, str], int]:
        return {pair: rank for rank, pair in enumerate(self.merges)}

    @cached_property
    def _lengths(self) -> dict[str, list[int]]:
        """By their last three symbols (of shorter ones: all), how many symbols tokens have, most first."""
        found: dict[str, set[int]] = {}
        for token in self.vocab:
            size = len(token) - len(self.suffix) * token.endswith(self.suffix)
            tail = token[max(0, size - 3) :]
            found.setdefault(tail, set()).add(size)
        return {tail: sorted(sizes, reverse=True) for tail, sizes in found.items()}

    @cached_property
    def _words(self) -> regex.Pattern:
        return regex.compile(self.pattern)

    @cached_property
    def _ascii_words(self) -> re.Pattern:
        """The same words in lower-case ASCII."""
        classes = {"\\p{L}": "a-z", "\\p{N}": "0-9", "\\p{White_Space}": "\\t-\\r "}
        return re.compile(reduce(lambda p, c: p.replace(*c), classes.items(), self.pattern))

    @cached_property
    def _specials(self) -> regex.Pattern | None:
        longest_first = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    @cached_property
    def _reached(self) -> dict[str, bool]:
        return {}

    @cached_property
    def _known(self) -> KnownWords:
        return KnownWords(self.special)

    @cached_property
    def _apart(self) -> dict[tuple[str, str], bool]:
        return {}

    @cached_property
    def _halves(self) -> dict[str, tuple[str, str]]:
        """The two tokens that the first merge giving a token puts together."""
        return {a + b: (a, b) for a, b in reversed(self.merges)}

    @cached_property
    def _made(self) -> dict[str, int]:
        """Rank of the merge that gives a token; single symbols have none."""
        return {t: self._ranks[pair] for t, pair in self._halves.items()}

    def merged(self, word: str, suffix: str = "") -> list[str]:
        """Plain merging of a word's symbols: the lowest rank first, the leftmost of equals."""
        parts = list(word)
        parts[-1] += suffix
        while len(parts) > 1:
            rank, at = min((self._ranks.get(pair, len(self._ranks)), i) for i, pair in enumerate(pairwise(parts)))
            if rank == len(self._ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reached(self, token: str) -> bool:
        """Whether merging a token's symbols gives the token itself."""
        if token not in self._reached:
            suffix = self.suffix if self.suffix and token.endswith(self.suffix) else ""
            self._reached[token] = self.merged(token.removesuffix(suffix), suffix) == [token]
        return self._reached[token]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens.

        The merges are undone from the last one back. At each moment the two pieces that touch
        the border are known; had they a merge of their own that comes earlier than the one
        just undone (at equal rank: on the left, as the leftmost goes first), it would have crossed.
        """
        ranks, halves, made = self._ranks, self._halves, self._made
        next_left, next_right = made.get(left, -1), made.get(right, -1)
        bound = len(ranks)
        while True:
            if ranks.get((left, right), bound) < bound:
                return False
            if next_left > next_right:
                bound, left = next_left, halves[left][1]
                next_left = made.get(left, -1)
            elif next_right >= 0:
                bound, right = next_right + 1, halves[right][0]
                next_right = made.get(right, -1)
            else:
                return True

    def last_token(self, word: str, length: int, states: list[str], suffix: str = "") -> str:
        """Last token of the encoding of ``word[:length]``, from the last tokens of shorter prefixes."""
        vocab, lengths, apart = self.vocab, self._lengths, self._apart
        short = word[length - 1 : length] + suffix
        sizes = lengths.get(word[length - 3 : length] + suffix, ()) if length > 2 else ()
        for size in (*sizes, 2) if length > 1 else ():
            if size <= length:
                token = word[length - size : length] + suffix
                if token in vocab:
                    before = states[length - size]
                    if before:
                        pair = before, token
                        found = apart.get(pair)
                        if found is None:
                            if len(apart) >= KEPT_PAIRS:
                                apart.clear()
                            found = apart[pair] = self.stay_apart(before, token)
                    else:
                        found = self.reached(token)
                    if found:
                        return token
        if short in vocab:  # what no longer token ends
            return short
        raise ValueError(f"no token ends {word[:length]!r}: a byte is missing from the vocabulary")

    def encode_words(self, words: set[str]) -> None:
        """Adds the ids of the words to the known ones."""
        by_symbols = {symbols(w): w for w in words}
        found: list[str] = []
        flat: list[int] = []
        sizes: list[int] = []
        vocab, suffix_size = self.vocab, len(self.suffix)
        for spelled, states in walk(by_symbols, "", self.last_token, reach=-1):
            end, ids = len(spelled), []
            token = self.last_token(spelled, end, states, self.suffix)
            end -= len(token) - suffix_size
            ids.append(vocab[token])
            while end:
                token = states[end]
                ids.append(vocab[token])
                end -= len(token)
            found.append(by_symbols[spelled])
            flat += reversed(ids)
            sizes.append(len(ids))
        self._known.add(found, flat, sizes)

    def pieces(self, text: str) -> list[str]:
        """Words of a normalized text, special strings as pieces of their own."""
        if self._specials is None or not any(s in text for s in self.special):
            return self.words(text)
        found: list[str] = []
        for part in self._specials.split(text):
            found += [part] if part in self.special else self.words(part)
        return found

    def words(self, text: str) -> list[str]:
        text = self.normalized(text)
        return (self._ascii_words if text.isascii() else self._words).findall(text)

    @staticmethod
    def normalized(text: str) -> str:
        """NFC, then lower case character by character, so a final sigma is like any other."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the offsets of each text in them."""
        words, places, counts = numbered(map(self.pieces, texts))
        known = self._known
        known.make_room()
        self.encode_words(set(words).difference(known.places))
        of_words = np.fromiter(map(known.places.__getitem__, words), np.int64, len(words))
        known.uses[of_words] += 1
        flat, ends = known.gather(of_words[places])
        return flat, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    @cached_property
    def _token_texts(self) -> pa.Array:
        return pa.array(self.tokens, pa.string())

    def decode(self, lists: pa.Array) -> pa.Array:
        """Texts of lists of ids: tokens as written, joined by a blank; ids of no token leave nothing."""
        tokens, flat = self._token_texts, lists.flatten()
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        kept = np.concatenate([[0], np.cumsum(inside.to_numpy(zero_copy_only=False), dtype=np.int64)])
        words = tokens.take(flat.filter(inside))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept[offsets], pa.int32()), words), " ")


class KnownWords:
    """Ids of words met before, in one array, and the place of each word in it.

    Special strings are always known. Past ``KEPT_WORDS`` the half stays, at most, that most slices of text used, and of
    that only words of two slices and more; a word that goes costs time only.
    """

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.places: dict[str, int] = {s: i for i, s in enumerate(special)}
        self.flat = np.fromiter(special.values(), np.int32, len(special))
        self.ends = np.arange(1, len(special) + 1)
        self.uses = np.zeros(len(special), np.int64)

    def make_room(self) -> None:
        if len(self.places) <= KEPT_WORDS:
            return
        fixed = len(self.special)
        often = fixed + np.flatnonzero(self.uses[fixed:] > 1)
        if len(often) > KEPT_WORDS // 2:
            often = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: KEPT_WORDS // 2]])
        kept = np.concatenate([np.arange(fixed), often])
        stays = np.zeros(len(self.ends), bool)
        stays[kept] = True
        flags = stays.tolist()
        words = [word for word, place in self.places.items() if flags[place]]  # in the order of their places
        self.flat, self.ends = self.gather(kept)
        self.places = {word: i for i, word in enumerate(words)}
        self.uses = self.uses[kept] // 2  # what was frequent long ago fades

    def add(self, words: list[str], flat: list[int], sizes: list[int]) -> None:
        first = len(self.ends)
        self.places.update(zip(words, range(first, first + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(np.array(sizes, np.int64))])
        self.uses = np.concatenate([self.uses, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places one after another, and where each word's ids end."""
        starts = np.concatenate([[0], self.ends])[places]
        sizes = self.ends[places] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(starts - ends + sizes, sizes)], ends


def load(spark: SparkSession, path: str) -> Broadcast:
    return shipped(spark).sparkContext.broadcast(WordBpe.from_file(path))


def encode_bpe(
    docs: DataFrame, model: Broadcast, text: str = "text", ids: str = "input_ids", decoded: str | None = None
) -> DataFrame:
    """Adds ``input_ids``, the token ids of each whole text, and if named the text they decode to.

    A null or empty text has none; special strings inside a text become their ids. Rows stay as they
    are, repeated ones too; columns of the added names are replaced, other columns are kept. With ``decoded``
    both ways are gone in the same worker, as by ``decode_bpe`` afterwards.
    """
    added = [ids] if decoded is None else [ids, decoded]
    rows = docs.drop(*[c for c in added if c != text])
    kept = rows.columns
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for batch in batches:
            column = batch.column(place)
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for first, end in slices(lengths, SLICE_CHARS):
                part = batch.slice(first, end - first)
                flat, offsets = bpe.encode([t or "" for t in part.column(place).to_pylist()])
                columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded is not None:
                    columns.append(bpe.decode(columns[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*kept, *added])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema)
    texts = "" if decoded is None else f", `{decoded}` string"
    return rows.mapInArrow(lambda batches: released(run(batches)), f"{fields}, `{ids}` array<int>{texts}")


def decode_bpe(rows: DataFrame, model: Broadcast, ids: str = "input_ids", text: str = "decoded") -> DataFrame:
    """Adds the decoded text: all tokens as written in the vocabulary, special ones too, joined by a blank.

    A null or empty list of ids decodes to an empty text; an id outside the vocabulary leaves nothing.
    """

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return model.value.decode(column)

    return rows.withColumn(text, decoded(F.col(ids)))
