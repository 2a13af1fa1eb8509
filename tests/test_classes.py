"""The Java character classes used by the grammars agree with Python's
``re`` classes on every Basic Multilingual Plane character."""

import re
import unicodedata

from logtab.functions.text import DIGIT, FLAGS, NON_SPACE, WORD


def _mismatches(spark, java_class, py_pattern):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r.c for r in df.where(df.c.rlike(f"{FLAGS}^{java_class}$")).collect()}
    want = {c for c in chars if re.match(py_pattern + r"\Z", c)}
    return sorted(got ^ want)


def test_space_class(spark):
    assert _mismatches(spark, NON_SPACE, r"\S") == []


def test_digit_class(spark):
    assert _mismatches(spark, DIGIT, r"\d") == []


def test_word_class(spark):
    # Java 17 knows Unicode 13; the only differences allowed are letters
    # assigned since, which Python's newer tables already call word characters
    for c in _mismatches(spark, WORD, r"\w"):
        assert unicodedata.category(c).startswith("L") and re.match(r"\w", c), hex(ord(c))


def test_strip_matches_python(spark):
    from logtab.functions.text import WHITESPACE_CHARS, strip

    samples = ["", "a", " a", "a ", "\ta\r", "x　", " x", "x\xa0", "\x85x\x85", "é", "aé", "é ",
               "\x1cx\x1f", "a b", "   ", "ü ", "end" + "x" * 500 + " "]
    samples += [ch + "k" + ch for ch in WHITESPACE_CHARS]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(samples)] + [(len(samples), None)], "i int, v string")
    got = {r.i: r.s for r in df.select("i", strip("v").alias("s")).collect()}
    assert got == {**{i: v.strip() for i, v in enumerate(samples)}, len(samples): None}
