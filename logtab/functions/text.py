"""String helpers with Python ``str`` semantics, expressed as Spark Columns.

Log grammars in this package were specified against Python's ``re`` and
``str`` behaviour.  Java's regex engine differs in a few character classes,
so the classes used by the grammars are spelled out here, built from a rule
(the running Python's Unicode tables) rather than typed in by hand.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every character Python's str.isspace() accepts (all lie below U+3001).
WHITESPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Hex codes of the ASCII characters among them.
ASCII_SPACE_HEX = [f"{ord(ch):02X}" for ch in WHITESPACE_CHARS if ord(ch) < 0x80]

# Last bytes of text that may end with one: those, and any of a character of
# several bytes.
SPACE_END_HEX = [*ASCII_SPACE_HEX, *[f"{b:02X}" for b in range(0x80, 0x100)]]

# Flags every grammar pattern starts with: UNIX_LINES, so '.' and '$' treat
# only '\n' as a line end (as Python does), and UNICODE_CHARACTER_CLASS, so
# \s is Unicode White_Space.
FLAGS = "(?dU)"

# Python-style classes for use inside Java patterns compiled with FLAGS.
# Unicode White_Space lacks U+001C..U+001F, which Python counts as space.
# (This short form is also several times faster in java.util.regex than
# listing the same characters as ranges.)
WS = r"\s\x1C-\x1F"               # class body: Python \s
WORD = r"[\p{L}\p{N}_]"           # Python \w on str: isalnum() or '_'
DIGIT = r"\p{Nd}"                 # Python \d on str: decimal digits, any script
NON_SPACE = f"[^{WS}]"            # Python \S

# Decimal digits of every script mapped to ASCII, for int conversion the way
# Python's int() reads them.  Built from the Unicode database by rule.
_ND = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]
_ND = [c for c in _ND if not ("0" <= c <= "9")]
DIGITS_FROM = "".join(_ND)
DIGITS_TO = "".join(str(unicodedata.digit(c)) for c in _ND)


def strip(c: Column | str) -> Column:
    """``str.strip()``: remove Python whitespace from both ends.

    Spark's trim with a character set walks (and allocates for) the whole
    string, so it only runs when an end character is whitespace - rarely,
    for log text.
    """
    c = _col(c)
    ws = F.lit(WHITESPACE_CHARS)
    # the last byte and an order of the first ones, as substrings of text
    # would count all its characters; the ranges hold all whitespace
    # characters and few others
    first = (c < "!") | c.between("\x80", "\xc0") | c.between("\u1000", "\u4000")
    last = F.hex(F.substring(c.cast("binary"), -1, 1)).isin(*SPACE_END_HEX)
    return F.when(first | last, F.btrim(c, ws)).otherwise(c)


def ascii_digits(c: Column | str) -> Column:
    """Map decimal digits of any script to ASCII '0'-'9' (pure-ASCII input,
    the usual case, is passed through without the table lookup)."""
    c = _col(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, DIGITS_FROM, DIGITS_TO))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
