import re
from collections import Counter

import pytest
from cases import empty_table, odd_rows, odd_table

from corpusweave.llm.quality import line_rule, rate, rate_quality, repeated_window_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    base_failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base_failed


def test_measures_equal_plain_ones(spark):
    rows = rate_quality(odd_table(spark, clashes=True)).collect()
    assert Counter((r["doc_id"], *r[1:7]) for r in rows) == Counter((r[0], *plain(r[1])) for r in odd_rows())
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert rate_quality(empty_table(spark)).collect() == []


@pytest.mark.parametrize(
    "line, rule",
    [
        ("This is a plain sentence.", None),
        ("A sentence that ends. and goes on", None),
        ("Home | About | Contact | Help", "navigation"),
        ("win### now$$$ free*** cash%%%", "boilerplate"),
        ("All Rights Reserved 2024", "boilerplate"),
        ("READ!! THIS!! NOW!! PLEASE!!", "punctuation"),
        ("no mark at the end of this", "punctuation"),
        ("buy buy buy buy buy buy buy now.", "repetition"),
        ("Short title", None),
        ("", None),
        (" \t ", None),
    ],
)
def test_line_rules(line, rule):
    assert line_rule(line.encode()) == rule


def test_failing_lines_go_and_a_text_that_loses_too_much_is_rejected():
    good = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(12))
    bad = "Home | About | Contact | Help | News | Shop"
    some, most = good + "\n" + bad, good + "\n" + "\n".join(f"{bad} | {i} | a{i} | b{i} | c{i}" for i in range(9))
    kept = rate(some)
    assert kept[6] and kept[7] == 1 and kept[9] == good
    assert not rate(most)[5] and not rate(most)[6]


def test_repeated_windows_count_the_first_too():
    assert repeated_window_words(b"a b c a b c".split()) == 6
    assert repeated_window_words(b"a a a a".split()) == 4
    assert repeated_window_words(b"a b c".split()) == 0
    assert repeated_window_words(b"x a b c y a b c".split()) == 6
