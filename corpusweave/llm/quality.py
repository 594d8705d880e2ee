"""Line-first cleaning of texts and a verdict on what is left.

Each line is held against the rules on its own; failing lines go, and a document that loses too much
of its text goes as a whole. A line of at least ``MIN_LINE_WORDS`` words fails if

* punctuation: it has no closing mark at its end and no sentence mark inside, or over
  ``MAX_SHOUTED`` of its words end in an exclamation or question mark;
* navigation: over ``MAX_SEPARATORS`` of its words are bare separators, as in menus and tables;
* boilerplate: it holds one of the stock phrases of page furniture, or over ``MAX_SYMBOLS`` symbols
  per word;
* repetition inside the line: one word makes up over ``MAX_ONE_WORD`` of it.

Blank lines neither fail nor count; lines of fewer words fail only as boilerplate.

Plan: one scan, no shuffle; texts are worked off one at a time, so a task holds one Arrow batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusweave.llm.common import released, shipped, strings
from corpusweave.llm.trie import slices

MIN_WORDS = 50
MIN_LINE_WORDS = 4
MAX_SHOUTED = 0.3
MAX_SEPARATORS = 0.2
MAX_SYMBOLS = 0.3
MAX_ONE_WORD = 0.5
MAX_LOST = 0.5

SYMBOLS = re.compile(r"[#*$%&|<>]")
SEPARATORS = {b"|", b">", b"<", b"/", b"\\", b"-", b"\xc2\xbb", b"\xe2\x80\xa2", b"\xc2\xb7", b"::"}
CLOSING = (b".", b"!", b"?", b"\"", b"'", b")", b":", b";", b"\xe2\x80\x9d", b"\xe2\x80\xa6", b"\xe3\x80\x82")
# Stock phrases of page furniture, in lower case.
BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|use of cookies"
    rb"|enable javascript|javascript is disabled|lorem ipsum|subscribe to our newsletter|sign up for our newsletter"
    rb"|skip to (?:main )?content|back to top|powered by wordpress|click here to|page not found|read more \xc2\xbb"
)


def line_rule(line: bytes) -> str | None:
    """Name of the first rule a line fails, if any; the line has no line break."""
    words = line.split()
    if not words:
        return None
    if BOILERPLATE.search(line.lower()):
        return "boilerplate"
    n = len(words)
    if n < MIN_LINE_WORDS:
        return None
    if sum(w in SEPARATORS for w in words) > MAX_SEPARATORS * n:
        return "navigation"
    if sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))) > MAX_SYMBOLS * n:
        return "boilerplate"
    if sum(w.endswith((b"!", b"?")) for w in words) > MAX_SHOUTED * n:
        return "punctuation"
    if not words[-1].endswith(CLOSING) and not any(w.endswith((b".", b"!", b"?")) for w in words):
        return "punctuation"
    if n >= 2 * MIN_LINE_WORDS and Counter(words).most_common(1)[0][1] > MAX_ONE_WORD * n:
        return "repetition"
    return None


def clean_lines(text: str) -> tuple[str, int, int]:
    """The text without its failing lines, how many failed, and the bytes of words that went with them."""
    kept, failed, lost = [], 0, 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if line_rule(line):
            failed += 1
            lost += sum(map(len, line.split()))
        else:
            kept.append(line)
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), failed, lost


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words occurring twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + size - max(i, end)
            end = i + size
    return covered


def repeated_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def rate(text: str) -> tuple:
    """The measures of a text, its verdict and its cleaned form, in the order of ``FIELDS``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words, repeated = len(words), repeated_window_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeated > 50 * n_words
    cleaned, failed, lost = clean_lines(text)
    size = sum(map(len, words))
    lost_share = lost / size if size else 0.0
    kept = not base_failed and lost_share <= MAX_LOST
    word_chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    n_symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return n_words, word_chars, n_symbols, repeated_lines(raw), repeated, base_failed, kept, failed, lost_share, cleaned


FIELDS = [
    ("n_words", pa.int64(), "long"),
    ("word_chars", pa.int64(), "long"),
    ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"),
    ("n_repeat_words", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"),
    ("n_failed_lines", pa.int64(), "long"),
    ("lost_share", pa.float64(), "double"),
    ("cleaned", pa.string(), "string"),
]
CHUNK_CHARS = 4_000_000


def rate_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the fields above for each row.

    A null text has no words and no lines, so it fails the base rule and its cleaned text is empty.
    Repeated rows are rated each, a null key stays, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for first, end in slices(lengths, CHUNK_CHARS):
                part = batch.slice(first, end - first)
                rated = zip(*map(rate, strings(part.column(1))), strict=True)
                columns = [pa.array(c, f[1]) for c, f in zip(rated, FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, *[f[0] for f in FIELDS]])

    shipped(docs.sparkSession)
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(lambda batches: released(run(batches)), f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS))
