"""Parts of chat text cleaning; ``operators.chat`` puts them together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A role at the start of a line, with or without a turn tag. The flags
# fold case and let ^ match at every line (ended by \n alone); spaces are those above.
ROLE_PATTERN = (
    r"(?imdu)^\s*(?:<start_of_turn>\s*)?(?:<\|?(?:assistant|model|user|system)\|?>\s*:?\s*"
    r"|(?:assistant|model|user|system)\s*:?\s*|a:\s*)"
).replace(r"\s", f"[{SPACE_CHARS}]")

# Marks that continue a list or a quotation.
CONTINUATION_MARKS = ":-•*>"

# The separators between a role word and its text.
ROLE_SEPARATORS = ": \n\t"

# How short and how long a tail may be.
MIN_TAIL_CHARS = 10
MAX_TAIL_SHARE = 0.9


def last_offset(text: Column, word: str) -> Column:
    """Characters before the last occurrence of ``word``; -1 where there is none."""
    behind = F.length(F.substring_index(text, word, -1))
    return F.when(F.instr(text, word) > 0, F.length(text) - behind - len(word)).otherwise(-1)


def occurs_before(text: Column, word: str, offset: Column) -> Column:
    """Whether ``word`` occurs wholly in the first ``offset`` characters."""
    return F.instr(F.substring(text, F.lit(1), offset), word) > 0


def text_behind(text: Column, offset: Column) -> Column:
    """What follows a role word that ends at ``offset``, without separators and blanks."""
    behind = F.substring(text, offset + 1, F.length(text))
    return F.btrim(F.ltrim(behind, F.lit(ROLE_SEPARATORS)), F.lit(SPACE_CHARS))


def drop_first_role(text: Column) -> Column:
    """Text without the first line-leading role marker, stripped."""
    halves = F.split(text, ROLE_PATTERN, 2)
    return F.btrim(F.concat_ws("", halves), F.lit(SPACE_CHARS))


def drop_continuation_marks(text: Column) -> Column:
    """Stripped text without its leading list and quotation marks."""
    return F.ltrim(text, F.lit(CONTINUATION_MARKS + SPACE_CHARS))
