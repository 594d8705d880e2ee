"""Depth-first traversal of the trie of a set of words, without building its nodes.

Words in sorted order visit their trie depth first: what a word shares with the word before
it is a path already walked, so its states are still on the stack and only the new nodes
below that path are computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np

State = TypeVar("State")


def shared_length(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def walk(
    words: Iterable[str], root: State, step: Callable[[str, int, list[State]], State], reach: int = 0
) -> Iterator[tuple[str, list[State]]]:
    """Each distinct word with the states of its prefixes.

    ``step(word, length, states)`` gives the state of ``word[:length]`` from those of all shorter
    prefixes, ``states[0]`` being the root. It is called once per trie node, for prefixes up to
    ``len(word) + reach``: -1 leaves the whole word to the caller. The list is reused: read
    it before the next word.
    """
    states = [root]
    before = ""
    for word in sorted(set(words)):
        del states[shared_length(before, word) + 1 :]
        for length in range(len(states), len(word) + reach + 1):
            states.append(step(word, length, states))
        yield word, states
        before = word


class Numbering(dict):
    """Numbers of words, by the order of their first use."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def numbered(texts: Iterable[Iterable[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts, all their words as places among them, and the words of each text.

    The words of one text at a time are held as strings.
    """
    places = Numbering()
    flat = [np.fromiter(map(places.__getitem__, words), np.int32) for words in texts]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    return list(places), np.concatenate([np.zeros(0, np.int32), *flat]), sizes


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose lengths add up to about ``budget``, at least one item each."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)
