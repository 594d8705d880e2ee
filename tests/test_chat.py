import pytest

from corpusweave.operators.chat import strip_role_markers

CASES = [
    ("Assistant: hello", "hello"),
    ("Modeling is fun", "ing is fun"),
    ("Hello\nuser: hi there", "Hello\nhi there"),
    ("user: what is two plus two?\nmodel: it is four, of course", "it is four, of course"),
    ("user: a\nmodel: short", "a\nmodel: short"),
    ("<|assistant|> : - * ok", "ok"),
    ("<start_of_turn>model\nHi", "Hi"),
    ("A: yes", "yes"),
    ("a: x", "x"),
    ("> - quoted", "quoted"),
    ("", ""),
    (None, None),
    ("no marker", "no marker"),
    ("  \n\t ", ""),
    ("• one • two", "one • two"),
    # The tail must stay under nine tenths of the text: it is 90 of 100, then 90 of 102.
    ("usermodel:" + "x" * 90, "model:" + "x" * 90),
    ("user model: " + "x" * 90, "x" * 90),
    # "user" must end before the last marker begins.
    ("model user: this text goes on and on", "user: this text goes on and on"),
    # The later of both roles counts.
    ("user: q\nmodel: first answer\nassistant: the second answer", "the second answer"),
    ("user: q\nassistant: first answer\nmodel: the second answer", "the second answer"),
    ("USER: q is here\nMODEL: THE LOUD ANSWER", "THE LOUD ANSWER"),
    # Characters beyond the basic plane count once.
    ("😀😀 user: q?\nmodel: 😀 ten chars 😀", "😀 ten chars 😀"),
    ("😀\nsystem: rules", "😀\nrules"),
    # Unicode white space is space, and long s folds to s.
    (" assistant : hi　", "hi"),
    ("uſer: hi", "hi"),
    ("\x1cuser: hi", "hi"),
    ("one\n\x1d\x1euser:\x1f hi", "one\nhi"),
    ("one\rmodel two", "one\rmodel two"),
]


@pytest.mark.parametrize("text, want", CASES)
def test_stripping(spark, text, want):
    rows = spark.createDataFrame([(1, text)], "turn INT, said STRING")
    assert tuple(strip_role_markers(rows, "said").first()) == (1, want)
