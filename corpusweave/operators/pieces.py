"""Encoding by pieces of words against a vocabulary table, and decoding that gives the text back.

A vocabulary of pieces is a table ``(token, id)`` like any other. A token begins a word; behind the mark ``##`` it
goes on with one; ``<0x00>`` to ``<0xFF>`` are single bytes, and ``<w>`` begins a word with nothing. A text is cut
at each single ASCII blank (space, tab, line feed, vertical tab, form feed, carriage return), and each word into the
longest tokens that match, from the left. Where no token begins the word, ``<w>`` does; a character that
no token goes on with is written as its bytes. A space is not written: a token that begins a word stands
for the space before it, unless it is the first one or follows another blank, which is a byte. An empty word is
written, as ``<w>``, only where a space stands beside it. So every text has exactly one form, an empty one has
no ids at all, and decoding an encoded text gives it back to the byte.

Matching walks a trie in flat arrays, all distinct words of an Arrow batch in step. Where a walk cannot go
on, its node says which tokens are thereby settled and where to go on (failure links), so no character is
read twice. Both directions are codecs: they take the vocabulary's place in ``encode``, ``encode_prompts``,
``decode`` and in whole runs. The vocabulary is broadcast and bounded like that of the form ``"lookup"``.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.operators.encode import Codec, broadcast_arrays, one_id_per_token
from corpusweave.operators.vocab import SPECIAL_TOKENS, invert, word_counts
from corpusweave.params import Specials

MARK = "##"
WORD = "<w>"
BYTES = [f"<0x{byte:02X}>" for byte in range(256)]
SPACE = 32
BLANKS = np.array([9, 10, 11, 12, 13, SPACE], np.uint8)
BEGIN, GO_ON = 0, 1  # the two roots of the trie
SLICE_BYTES = 2 << 20  # of text that is cut at once; a longer text is a slice of its own
FEW = 32  # so many words or fewer are walked one by one

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


@dataclass
class Lists:
    """Id lists as one flat array with bounds."""

    flat: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        lengths = [len(one) for one in lists]
        flat = np.array([i for one in lists for i in one], np.int32)
        return cls(flat, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))

    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    def joined(self, groups: np.ndarray, members: np.ndarray, n: int) -> Lists:
        """Per group, in the order given, its members' lists as one; groups are 0 to n - 1."""
        order = np.argsort(groups, kind="stable")
        groups, members = groups[order], members[order]
        lengths = self.lengths()[members]
        flat = self.flat[ranges(self.bounds[members], lengths)]
        per_group = np.bincount(groups, weights=lengths, minlength=n).astype(np.int64)
        return Lists(flat, np.concatenate([[0], np.cumsum(per_group)]))

    def plus(self, other: Lists) -> Lists:
        return Lists(np.concatenate([self.flat, other.flat]), np.concatenate([self.bounds, other.bounds[1:] + self.bounds[-1]]))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the bounds of each text among them."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), "")[0].as_py() or ""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(joined.encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum(lengths)])


@dataclass
class PieceTrie:
    """Nodes are numbers; ``edges`` holds node * letters + letter in ascending order, ``children`` its node."""

    alphabet: np.ndarray
    edges: np.ndarray
    children: np.ndarray
    settled: Lists  # what a node settles when a walk cannot go on from it
    failure: np.ndarray  # and where it goes on then
    byte_ids: np.ndarray

    def letters(self, chars: np.ndarray) -> np.ndarray:
        """Places in the alphabet; -1 for a character that no token holds."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == chars, at, -1)

    def child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Child of each node by a letter, -1 for none."""
        edge = nodes * len(self.alphabet) + letters
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where((letters >= 0) & (self.edges[at] == edge), self.children[at], -1)

    def cut(self, words: pa.Array) -> Lists:
        """Ids of the pieces of each word."""
        chars, bounds = code_points(words)
        letters = np.append(self.letters(chars), -1)
        strange = np.unique(chars[letters[:-1] < 0])
        spelling = np.searchsorted(strange, chars)
        spelled = Lists.of([self.byte_ids[list(chr(c).encode())].tolist() for c in strange])
        word, at, end = np.arange(len(words)), bounds[:-1].copy(), bounds[1:]
        node = np.full(len(words), BEGIN, np.int64)
        seen = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        while word.size > FEW:
            ended = at == end
            following = self.child(node, np.where(ended, -1, letters[at]))
            goes, root = following >= 0, node == GO_ON
            fails, spells = ~goes & ~root, ~goes & root & ~ended
            as_bytes = len(self.failure) + spelling[at[spells]]
            seen += [(word[fails], node[fails]), (word[spells], as_bytes)]
            node = np.where(goes, following, np.where(fails, self.failure[node], node))
            at = at + (goes | spells)
            if (ended & root).any():
                stays = ~(ended & root)
                word, at, end, node = word[stays], at[stays], end[stays], node[stays]
        for one in zip(word.tolist(), at.tolist(), end.tolist(), node.tolist()):
            seen.append(self.cut_on(letters, spelling, *one))
        groups, members = (np.concatenate(parts) for parts in zip(*seen))
        return self.settled.plus(spelled).joined(groups, members, len(words))

    def cut_on(self, letters, spelling, word: int, at: int, end: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The rest of one word's walk, as its number and the lists that it gives."""
        edges, rest, members = memoryview(self.edges), letters[at:end].tolist(), []
        start, n_letters = at, len(self.alphabet)
        while at < end or node != GO_ON:
            letter = rest[at - start] if at < end else -1
            edge = node * n_letters + letter
            place = bisect_left(edges, edge) if letter >= 0 else len(edges)
            if place < len(edges) and edges[place] == edge:
                node, at = int(self.children[place]), at + 1
            elif node == GO_ON:
                members.append(len(self.failure) + int(spelling[at]))
                at += 1
            else:
                members.append(node)
                node = int(self.failure[node])
        return np.full(len(members), word), np.array(members, np.int64)


def piece_trie(tokens: list[str], ids: list[int], special: list[int]) -> PieceTrie:
    """The trie of a vocabulary; special tokens are never matched in a text."""
    table = dict(zip(tokens, ids))
    if lacking := [t for t in (WORD, *BYTES) if t not in table]:
        raise ValueError(f"a vocabulary of pieces needs {WORD} and all bytes; it lacks {lacking[0]}")
    byte_ids = np.array([table[t] for t in BYTES], np.int32)
    plain = set(table) - {WORD, *BYTES, "", *(t for t, i in table.items() if i in special)}
    settles = {}
    for token in plain:
        inner = token.startswith(MARK) and token != MARK
        settles[GO_ON if inner else BEGIN, token[len(MARK) :] if inner else token] = [table[token]]
    for letter in sorted({c for _, body in settles for c in body} or {" "}):
        settles.setdefault((GO_ON, letter), byte_ids[list(letter.encode())].tolist())
    keys = sorted(settles)
    own = Lists.of([settles[key] for key in keys])
    chars, bounds = code_points(pa.array([body for _, body in keys], pa.string()))
    alphabet = np.unique(chars)
    letters = np.searchsorted(alphabet, chars)
    node, depth = np.array([root for root, _ in keys], np.int64), 0
    long, levels, size = np.arange(len(keys)), [], 2
    while long.size:
        edge, place = np.unique(node * len(alphabet) + letters[bounds[long] + depth], return_inverse=True)
        node, depth = size + place, depth + 1
        ends = bounds[long] + depth == bounds[long + 1]
        own_token = np.full(len(edge), -1)
        own_token[place[ends]] = long[ends]
        levels.append((edge, own_token))
        size += len(edge)
        long, node = long[~ends], node[~ends]
    edges = np.concatenate([edge for edge, _ in levels])  # ascending, as nodes are numbered by level
    opened = Lists.of([[table[WORD]], []])
    trie = PieceTrie(alphabet, edges, np.arange(2, size), opened, np.array([GO_ON, GO_ON]), byte_ids)
    for edge, own_token in levels:
        _settle(trie, edge, own_token, own)
    return trie


def _settle(trie: PieceTrie, edge: np.ndarray, own_token: np.ndarray, own: Lists) -> None:
    """What the nodes of one level settle, from the levels above it: a token itself, else what its
    parent settles and what it takes from there to go on with the letter."""
    parent, letter = np.divmod(edge, len(trie.alphabet))
    is_token = own_token >= 0
    failure = np.full(len(edge), GO_ON, np.int64)
    n_nodes = len(trie.failure)
    seen = [(np.flatnonzero(is_token), n_nodes + own_token[is_token])]
    rest = np.flatnonzero(~is_token)
    state = parent[rest]
    while rest.size:
        seen.append((rest, state))
        state = trie.failure[state]
        following = trie.child(state, letter[rest])
        found = following >= 0
        failure[rest[found]] = following[found]
        rest, state = rest[~found], state[~found]
    groups, members = (np.concatenate(parts) for parts in zip(*seen))
    trie.settled = trie.settled.plus(trie.settled.plus(own).joined(groups, members, len(edge)))
    trie.failure = np.concatenate([trie.failure, failure])


def batch_ids(trie: PieceTrie, batch: pa.Array) -> pa.ListArray:
    """Ids of each text of an Arrow batch; null for null."""
    if not len(batch):
        return pa.array([], pa.list_(pa.int32()))
    batch = batch.cast(pa.string())
    ends = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset + 1 : batch.offset + len(batch) + 1]
    cuts = np.unique(np.searchsorted(ends, np.arange(ends[0], ends[-1], SLICE_BYTES, dtype=np.int64)))
    cuts = [0, *cuts[cuts > 0].tolist(), len(batch)]
    return pa.concat_arrays([slice_ids(trie, batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def slice_ids(trie: PieceTrie, batch: pa.Array) -> pa.ListArray:
    row_bounds = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
    body = batch.buffers()[2]
    data = np.frombuffer(body if body is not None else b"", np.uint8)[: row_bounds[-1]]
    blanks = row_bounds[0] + np.flatnonzero(np.isin(data[row_bounds[0] :], BLANKS))
    starts = np.sort(np.concatenate([row_bounds[:-1], blanks + 1]))
    ends = np.sort(np.concatenate([row_bounds[1:], blanks]))
    first = np.arange(len(batch)) + np.searchsorted(blanks, row_bounds[:-1])  # each row's first word
    before = np.zeros(len(starts), np.int64)
    later = np.setdiff1d(np.arange(len(starts)), first, assume_unique=True)
    before[later] = data[starts[later] - 1]
    after = np.append(before[1:], 0)
    unwritten = (starts == ends) & (before != SPACE) & (after != SPACE)

    with_blank = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, row_bounds[-1]).astype(np.int32)), pa.py_buffer(data)
    )
    known = pc.ascii_rtrim(with_blank, BLANKS.tobytes().decode()).dictionary_encode()
    pieces = trie.cut(known.dictionary)
    word = known.indices.to_numpy()
    n_pieces = np.where(unwritten, 0, pieces.lengths()[word])
    as_byte = (before != 0) & (before != SPACE)
    stops = np.cumsum(n_pieces + as_byte)
    opens = stops - n_pieces - as_byte
    flat = np.empty(stops[-1] if len(stops) else 0, np.int32)
    flat[opens[as_byte]] = trie.byte_ids[before[as_byte]]
    flat[ranges(opens + as_byte, n_pieces)] = pieces.flat[ranges(pieces.bounds[word], n_pieces)]
    bounds = np.append(opens[first], len(flat)).astype(np.int32)
    nulls = batch.is_null() if batch.null_count else None
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat), mask=nulls)


def piece_encoder(vocab: DataFrame, specials: Specials) -> Codec:
    """Codec from a text to the ids of its pieces."""
    tokens, ids = broadcast_arrays(one_id_per_token(vocab))
    trie = piece_trie(tokens.to_pylist(), ids.to_pylist(), specials.ids())
    lists = (trie.settled.flat, trie.settled.bounds)
    arrays = {name: value for name, value in vars(trie).items() if name != "settled"}
    shared = vocab.sparkSession.sparkContext.broadcast((lists, arrays))

    @F.arrow_udf("array<int>")
    def pieces(batch: pa.Array) -> pa.Array:
        lists, arrays = shared.value
        found = batch_ids(PieceTrie(settled=Lists(*lists), **arrays), batch)
        pa.default_memory_pool().release_unused()
        return found

    return pieces


@dataclass
class PieceTexts:
    """Bytes of each id's token, those that begin a word a second time behind a space."""

    ids: pa.Array
    texts: pa.Array
    begins: np.ndarray
    blank: np.ndarray


def piece_texts(tokens: list[str], ids: list[int]) -> PieceTexts:
    spelled = {token: bytes([byte]) for byte, token in enumerate(BYTES)}
    spelled[WORD] = b""
    inner = [t in BYTES or (t.startswith(MARK) and t != MARK) for t in tokens]
    plain = [spelled.get(t, (t[len(MARK) :] if i else t).encode()) for t, i in zip(tokens, inner)]
    blank = [t in spelled and b in b"\t\n\x0b\x0c\r" and b != b"" for t, b in zip(tokens, plain)]
    texts = pa.array(plain + [b" " + b for b in plain], pa.binary())
    return PieceTexts(pa.array(ids, pa.int32()), texts, ~np.array(inner, bool), np.array(blank, bool))


def batch_texts(pieces: PieceTexts, batch: pa.Array) -> pa.Array:
    """Text of each row of ids; null for null. Ids without a token are left out, bytes that are no UTF-8 replaced."""
    place = pc.index_in(batch.flatten(), value_set=pieces.ids)
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    known = place.is_valid().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(known)])[bounds]
    at = place.drop_null().to_numpy()
    behind = np.ones(len(at) + 1, bool)  # first in its row, or behind a blank: no space is meant
    behind[1:] = pieces.blank[at]
    behind[bounds[:-1]] = True
    spaced = pieces.begins[at] & ~behind[:-1]
    taken = pieces.texts.take(pa.array(at + spaced * len(pieces.ids)))
    nulls = batch.is_null() if batch.null_count else None
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), taken, mask=nulls)
    joined = pc.binary_join(lists, b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        rows = (row if row is None else row.decode(errors="replace") for row in joined.to_pylist())
        return pa.array(rows, pa.string())


def piece_decoder(vocab: DataFrame) -> Codec:
    """Codec from ids, special ones left out, to the text."""
    tokens, ids = broadcast_arrays(invert(vocab))
    shared = vocab.sparkSession.sparkContext.broadcast(vars(piece_texts(tokens.to_pylist(), ids.to_pylist())))

    @F.arrow_udf("string")
    def text(batch: pa.Array) -> pa.Array:
        return batch_texts(PieceTexts(**shared.value), batch)

    return text


def piece_vocabulary(corpus: DataFrame, size: int, longest: int = 3) -> DataFrame:
    """A stand-in vocabulary of pieces: special tokens, ``<w>`` and the bytes, then the most frequent among whole
    words, their beginnings and their inner parts of up to ``longest`` characters."""
    fixed = [*SPECIAL_TOKENS.items(), *((t, len(SPECIAL_TOKENS) + i) for i, t in enumerate([WORD, *BYTES]))]
    letters = F.regexp_extract_all(F.col("token"), F.lit("(?s)."), F.lit(0))
    counted = word_counts(corpus).select("token", "occurrences", letters.alias("letters"))

    def parts(_: Column, i: Column) -> Column:
        marked = F.when(i == 0, "").otherwise(MARK)
        of_length = [F.concat(marked, *(F.get("letters", i + j) for j in range(n))) for n in range(1, longest + 1)]
        return F.filter(F.array(*of_length), lambda part: part.isNotNull() & (part != F.col("token")))

    tokens = F.concat(F.array("token"), F.flatten(F.transform("letters", parts)))
    pieces = counted.select(F.explode(tokens).alias("token"), "occurrences").groupBy("token").agg(F.sum("occurrences").alias("n"))
    lacking = pieces.where(~F.col("token").isin([t for t, _ in fixed]))
    top = lacking.orderBy(F.desc("n"), "token").limit(size - len(fixed))
    ranked = top.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))).alias("all"))
    frequent = ranked.select(F.posexplode("all.token").alias("place", "token"))
    frequent = frequent.select("token", (F.col("place") + len(fixed)).cast("int").alias("id"))
    special = corpus.sparkSession.createDataFrame(fixed, "token STRING, id INT")
    return frequent.unionByName(special)
