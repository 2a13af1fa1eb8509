"""Log grammars ("parsers") as Spark Column expressions.

A parser recognises a line, projects its header into typed base fields and
extracts free-form parameters as (key, value) arrays.  Everything a parser
returns is a Column, so routing, projection and pair extraction for the
built-in grammars run inside whole-stage generated code with no Python
worker.  ``PythonLogParser`` adapts an arbitrary Python function through an
Arrow-batched pandas UDF for grammars regexes cannot express.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtab.functions.dates import stamp_fields
from logtab.functions.kv import pairs
from logtab.functions.text import DIGIT, FLAGS, NON_SPACE, WORD, WS, strip

# Marks a successful one-pass header scan; a matching line starts with a word
# character, so it can never start with this itself.
SENTINEL = "\u0001"
# Separates captured groups in the scan result.  No captured group can
# contain a newline, and lines never do.
SEP = "\n"
# How a header pattern reads the rest of a line.
REST = r"(.*)$\n?"
# From this many bytes on, text is read by means that do not look at each
# character, as regexes do; Java's search for one character is tens of times
# faster.  Texts of over ``MOST_CUT`` bytes are left to the regexes, which read
# them as they lie; pieces would take the memory of the text again.
LONG_TEXT = 4096
MOST_CUT = 1 << 20


class UnparsableLogError(Exception):
    """Raised by a Python parser function to decline a line."""


class LogParser(ABC):
    """A log grammar.

    ``name`` labels the route and the output table; ``base_fields`` are the
    header fields every record of this grammar carries, in output order, as
    ``(name, spark type)``.
    """

    name: str
    base_fields: Sequence[tuple[str, str]] = ()
    # whether parameter keys lose the white space around them
    strip_keys: bool = True
    # whether lines carry parameters at all
    has_pairs: bool = True
    # a literal token that every line of the grammar holds; see ``route.line_tokens``
    token: str | None = None

    def scan(self, line: Column) -> Column:
        """The one expensive pass over a candidate line (materialised once)."""
        return line

    @abstractmethod
    def fields(self, line: Column, scanned: Column) -> Column:
        """Captured header data; null exactly when the line is not this grammar's."""

    def date(self, f: Column, year: int) -> tuple[Column, Column | None, Column | None]:
        """``(ok, compact, iso)`` for the record date; grammars without a date return ``(true, None, None)``."""
        return F.lit(True), None, None

    @abstractmethod
    def base(self, f: Column, compact: Column | None, iso: Column | None) -> list[Column]:
        """Base field values aligned with ``base_fields``."""

    @abstractmethod
    def pairs(self, f: Column) -> tuple[Column, Column]:
        """Raw (keys, values) arrays of the parameter text, in text order."""

    def cut(self, f: Column) -> Column | None:
        """Pieces of a long parameter text, null for others (materialised
        once).  A grammar may have such pieces to find the pairs faster."""
        return None

    def cut_pairs(self, pieces: Column) -> tuple[Column, Column]:
        """What ``pairs`` gives, from the pieces alone; null where
        ``joined_pairs`` must read them."""
        raise NotImplementedError

    def joined_pairs(self, pieces: Column) -> tuple[Column, Column]:
        """``pairs`` of the text that the pieces make."""
        raise NotImplementedError

    def without_pairs(self, f: Column) -> Column:
        """``f`` without the parameter text."""
        return f

    @property
    def base_names(self) -> list[str]:
        return [n for n, _ in self.base_fields]

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.name!r})"


class _HeaderRegexParser(LogParser):
    """Grammar whose header is one anchored regex, scanned in a single pass.

    ``regexp_replace`` rewrites a matching line into ``SENTINEL`` followed by
    its groups joined by ``SEP`` (absent optional groups become empty); a line
    that does not match comes back unchanged.  One regex run thus yields both
    the match decision and all groups, instead of one run per group.

    A grammar with ``rest_apart`` runs the regex on the header alone, and cuts
    the rest of the line, which may be long, off as bytes.
    """

    header_pattern: str
    n_groups: int
    prefilter: str | None = None
    # whether the last group is ``REST`` behind a header that can match in one
    # way only and holds no newline and no U+FFFD (so its bytes are the line's)
    rest_apart = False

    def maybe(self, line: Column) -> Column:
        """Whether the line has ``prefilter`` or, if it is long, matches up to
        its last group: ``contains`` compares at each byte."""
        found = line.contains(self.prefilter)
        if not self.header_pattern.endswith(REST):
            return found
        return F.when(F.octet_length(line) < LONG_TEXT, found).otherwise(line.rlike(self.header_pattern.removesuffix(REST)))

    def scan(self, line: Column) -> Column:
        n, pattern = self.n_groups, self.header_pattern
        if self.rest_apart:
            n, pattern = n - 1, pattern.removesuffix(REST)
        repl = SENTINEL + SEP.join(f"${i}" for i in range(1, n + 1))
        if self.rest_apart:
            head = F.regexp_extract(line, pattern, 0)
            rest = F.substring(line.cast("binary"), F.octet_length(head) + 1, F.octet_length(line)).cast("string")
            return F.when(head != "", F.concat(F.split(F.regexp_replace(head, pattern, repl), SEP), F.split(rest, SEP, 2)))
        out = F.regexp_replace(line, pattern, repl)
        return F.when(self.maybe(line), out) if self.prefilter else out

    def fields(self, line: Column, scanned: Column) -> Column:
        if self.rest_apart:  # ``REST`` takes a newline at the end only
            return F.when((F.size(scanned) == self.n_groups) | (F.get(scanned, F.lit(self.n_groups)) == ""), scanned)
        hit = scanned.startswith(SENTINEL) & ~line.startswith(SENTINEL)
        # the sentinel stays on the first group (stripped in ``g``), which is
        # short; cutting it off the whole line would walk every character
        return F.when(hit, F.split(scanned, SEP, self.n_groups))

    @staticmethod
    def g(f: Column, i: int) -> Column:
        first = f.getItem(0)
        return first.substr(F.lit(2), F.char_length(first)) if i == 1 else f.getItem(i - 1)

    @classmethod
    def opt(cls, f: Column, i: int) -> Column:
        return F.nullif(cls.g(f, i), F.lit(""))

    def date(self, f, year):
        return stamp_fields(*(self.g(f, i) for i in range(1, 6)), year=year)


# The two vendor grammars.  They must accept exactly what the
# original tool accepts, so they have its patterns with Python's \w, \d, \s, \S classes replaced by their exact Java
# equivalents from ``logtab.functions.text``, named groups replaced by numbered
# ones, the leading stamp split into month/day/hour/minute/second groups, and
# ``FLAGS`` (UNIX_LINES, UNICODE_CHARACTER_CLASS) in front.
_STAMP = rf"({WORD}+) [ ]?({DIGIT}+) ({DIGIT}{DIGIT}):({DIGIT}{DIGIT}):({DIGIT}{DIGIT})"
_D = DIGIT

HW_HEADER = (
    rf"{FLAGS}^{_STAMP} "
    rf"(?:([{_D}.]+) )?"
    rf"(?:{_D}{_D}{_D}{_D}-{_D}{_D}-{_D}{_D} {_D}{_D}:{_D}{_D}:{_D}{_D} )?"
    rf"({NON_SPACE}+) "
    rf"%%"
    rf"([^{WS}()\[\]]+?)"
    rf"(?:\(({NON_SPACE}+)\))?"
    rf"(?:\[({NON_SPACE}+)\])?"
    rf":"
    rf"{REST}"
)
HW_EQ_PAIRS = rf'{FLAGS}((?:(?<=, )|(?<=,)|(?<=\())[^{WS}()&,]+?)="?(.*?)"?(?:,|\.$|\)$)'
HW_COLON_PAIRS = FLAGS + r'(?:(?:(?<=; )|(?<=;)|(?<=\())(?:\[.*\])?([^()&,]+?)):"?(.*?)"?;'

CP_HEADER = (
    rf"{FLAGS}^{_STAMP} "
    rf"([{_D}.]+) "
    rf"(?:[+\-]{_D}{_D}:{_D}{_D}) "
    rf"([{_D}.]+) "
    rf"{REST}"
)
# The original's ``((?<=" ).*?):?="(.*?)"``: a key ends at the first ``="`` or
# ``:="``, which is stated here without trying the rest at every character.
CP_PAIRS = FLAGS + r'((?<=" )(?:[^=:\n]+|=(?!")|:(?!="))*+):?="([^"\n]*)"'


class HwParser(_HeaderRegexParser):
    """``Mon d HH:MM:SS [if1] [yyyy-mm-dd HH:MM:SS] if2 %%NAME[(round)][[square]]:params``

    Parameters are ``key=value`` pairs separated by commas and ``key:value``
    pairs terminated by semicolons; the latter override the former.
    """

    name = "hw"
    base_fields = (
        ("_a_timestamp", "bigint"),
        ("_b_datetime", "string"),
        ("_c_interface_1", "string"),
        ("_d_interface_2", "string"),
        ("_e_event_name", "string"),
        ("_f_event_brace_round", "string"),
        ("_g_event_brace_square", "string"),
    )
    header_pattern = HW_HEADER
    n_groups = 11
    prefilter = "%%"

    def base(self, f, compact, iso):
        return [
            compact.cast("bigint"), iso,
            self.opt(f, 6), self.g(f, 7), self.g(f, 8), self.opt(f, 9), self.opt(f, 10),
        ]

    def pairs(self, f):
        text = strip(self.g(f, 11))
        k1, v1 = pairs(F.concat(F.lit(","), text), HW_EQ_PAIRS)
        k2, v2 = pairs(F.concat(F.lit(";"), text), HW_COLON_PAIRS)
        return F.concat(k1, k2), F.concat(v1, v2)


class CpParser(_HeaderRegexParser):
    """``Mon d HH:MM:SS if1 ±hh:mm if2 key="value" key:="value" ...``"""

    name = "cp"
    base_fields = (
        ("_a_timestamp", "string"),
        ("_b_datetime", "string"),
        ("_c_interface_1", "string"),
        ("_d_interface_2", "string"),
    )
    header_pattern = CP_HEADER
    n_groups = 8
    rest_apart = True

    def base(self, f, compact, iso):
        return [compact, iso, self.g(f, 6), self.g(f, 7)]

    def pairs(self, f):
        return pairs(F.concat(F.lit('" '), strip(self.g(f, 8))), CP_PAIRS)

    # Text made of pairs is, between its quotes, ``key=`` or ``key:=``, a
    # value, `` key=``, a value and so on; a piece after the last quote has no
    # pair.  The regex reads any other text.

    def cut(self, f):
        return F.when(F.octet_length(self.g(f, 8)).between(LONG_TEXT, MOST_CUT), F.split(strip(self.g(f, 8)), '"'))

    def cut_pairs(self, pieces):
        n = F.size(pieces)

        def odd_one(s: Column, i: Column) -> Column:
            return (i % 2 == 0) & (i < n - 1) & ~(s.endswith("=") & ((i == 0) | s.startswith(" ")))

        def key(s: Column, i: Column) -> Column:  # as bytes: a substring of text counts its characters
            first = F.when(i == 0, 1).otherwise(2)
            end = F.octet_length(s) - F.when(s.endswith(":="), 2).otherwise(1)
            return F.substring(s.cast("binary"), first, end - first + 1).cast("string")

        whole = (n % 2 == 1) & (F.size(F.filter(pieces, odd_one)) == 0)
        body = F.slice(pieces, F.lit(1), n - 1)
        return (F.when(whole, F.transform(F.filter(body, lambda s, i: i % 2 == 0), key)),
                F.when(whole, F.filter(body, lambda s, i: i % 2 == 1)))

    def joined_pairs(self, pieces):
        return pairs(F.concat(F.lit('" '), F.array_join(pieces, '"')), CP_PAIRS)

    def without_pairs(self, f):
        return F.slice(f, 1, self.n_groups - 1)


class PythonLogParser(LogParser):
    """Adapt ``fn(line) -> dict`` (raise ``UnparsableLogError`` or return None
    to decline) into a parser.

    The function runs in Arrow batches through a pandas UDF; its record
    becomes the parameter map (keys as returned, values rendered with
    ``str``), so the grammar has no typed base fields.  Use it only for grammars the Column API cannot
    express: every line reaching it crosses into Python.
    """

    def __init__(self, name: str, fn: Callable[[str], dict | None]):
        self.name = name
        self.fn = fn
        self.base_fields = ()
        self.strip_keys = False

    def scan(self, line: Column) -> Column:
        fn = self.fn

        def one(s: str):
            if s is None:
                return None
            try:
                rec = fn(s)
            except UnparsableLogError:
                return None
            if rec is None:
                return None
            return [(str(k), None if v is None else str(v)) for k, v in rec.items()]

        @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])))
        def run(lines: pd.Series) -> pd.Series:
            return lines.map(one)

        return run(line)

    def fields(self, line, scanned):
        return scanned

    def base(self, f, compact, iso):
        return []

    def pairs(self, f):
        return F.transform(f, lambda e: e["k"]), F.transform(f, lambda e: e["v"])


class RegexParser(_HeaderRegexParser):
    """A user-defined grammar from patterns, compiled to Column expressions.

    ``header`` is an anchored Java regex whose numbered groups map, in order,
    to ``fields`` (all strings; an absent optional group gives null).  The
    group named by ``params_group`` (1-based, default: the last) is the
    parameter text, scanned by ``pair_pattern`` (two groups: key, value)
    after ``str.strip()`` and prefixing with ``pair_prefix``.  Groups must not
    be able to contain a newline.  A ``date_groups`` 5-tuple (month, day,
    hour, minute, second group numbers) adds ``_a_timestamp`` and
    ``_b_datetime`` from a syslog stamp.  ``strip_keys=False`` keeps the
    white space around parameter keys.  ``token`` is a word that every line of
    the grammar holds (letters, digits, ``_``, ``%`` and ``-``, between other
    characters): among many grammars, only lines with it run the regexes.
    """

    def __init__(self, name: str, header: str, fields: Sequence[str], pair_pattern: str | None = None,
                 pair_prefix: str = "", params_group: int | None = None, prefilter: str | None = None,
                 date_groups: tuple[int, int, int, int, int] | None = None, strip_keys: bool = True, token: str | None = None):
        self.name = name
        self.token = token
        self.strip_keys = strip_keys
        self.header_pattern = header
        self.prefilter = prefilter
        self.date_groups = date_groups
        self.field_names = list(fields)
        self.n_groups = len(self.field_names) + (1 if pair_pattern else 0) + (5 if date_groups else 0)
        self.params_group = params_group or self.n_groups
        self.pair_pattern = pair_pattern
        self.has_pairs = pair_pattern is not None
        self.pair_prefix = pair_prefix
        skip = set(date_groups or ()) | ({self.params_group} if pair_pattern else set())
        self.field_groups = [i for i in range(1, self.n_groups + 1) if i not in skip]
        dated = [("_a_timestamp", "string"), ("_b_datetime", "string")] if date_groups else []
        self.base_fields = tuple(dated + [(n, "string") for n in self.field_names])

    def date(self, f, year):
        if not self.date_groups:
            return F.lit(True), None, None
        return stamp_fields(*(self.g(f, i) for i in self.date_groups), year=year)

    def base(self, f, compact, iso):
        dated = [compact, iso] if self.date_groups else []
        return dated + [self.opt(f, i) for i in self.field_groups]

    def pairs(self, f):
        if not self.pair_pattern:
            empty = F.array().cast("array<string>")
            return empty, empty
        text = F.concat(F.lit(self.pair_prefix), strip(self.g(f, self.params_group)))
        return pairs(text, self.pair_pattern)


HW = HwParser()
CP = CpParser()
DEFAULT_PARSERS: tuple[LogParser, ...] = (HW, CP)
