"""Secret scans: fixed patterns, and password guess cost in context."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from logtab.llm.spans import Span, scan_texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # greedy runs, so those of 24 and more are just these
HINTS = (b"passw", b"secret", b"token", b"api")

# Places where a credential is likely to follow: wider than ``ASSIGN`` in
# names, in separators and in the characters of the value.
CONTEXT = re.compile(
    rb"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
    rb"|auth|authorization|bearer|credentials?|login|pin)[\"']?[\x20\t]*(?::=|=>|[:=]|\bis\b)[\x20\t]*[\"'`<]?"
    rb"([^\x20\x09-\x0D\"'`<>]{4,})", re.I)
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"login", b"pin")
TRAILING = b".,;:!?)]}"

MIN_BITS = 33.3  # about 10^10 guesses
SEGMENT_BITS = 1.0  # for each further segment: where it starts has to be guessed too
WORD_BYTES = 24

# Frequent parts of passwords, most frequent first.
COMMON = (
    "password", "qwerty", "admin", "welcome", "letmein", "monkey", "dragon", "login", "abc", "master", "hello",
    "freedom", "whatever", "trustno", "passw", "pass", "test", "guest", "root", "user", "secret", "changeme",
    "default", "example", "sample", "demo", "token", "key", "api", "love", "sunshine", "princess", "football",
    "baseball", "shadow", "superman", "batman", "michael", "jordan", "summer", "winter", "spring", "autumn",
    "flower", "computer", "internet", "server", "system", "manager", "public", "private", "access", "temp",
    "dummy", "placeholder", "your", "my", "the", "here", "value", "string", "none", "null", "true", "false",
    "undefined", "required", "optional", "redacted", "hidden", "removed", "xxx", "foo", "bar", "baz",
)

# Rows of the keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("0134578@$!", "oleastbasi")

YEAR = re.compile(r"(?:19|20)\d\d")
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:3[01]|[12]\d|0?[1-9])"),
    re.compile(r"(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\1(?:(?:19|20)\d\d|\d\d)"),
    re.compile(r"(?:1[0-2]|0?[1-9])([-/._]?)(?:3[01]|[12]\d|0?[1-9])\1(?:(?:19|20)\d\d|\d\d)"),
)


# Directions on the keyboard, whose rows are each shifted half a key.
MOVES = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))


def _neighbours() -> dict[str, dict[str, int]]:
    """Per key its neighbours, with the direction in which they lie."""
    out: dict[str, dict[str, int]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            near = ((d, r + dr, c + dc) for d, (dr, dc) in enumerate(MOVES))
            out[key] = {ROWS[y][x]: d for d, y, x in near if 0 <= y < len(ROWS) and 0 <= x < len(ROWS[y])}
    return out


NEAR = _neighbours()
WALK_BITS = math.log2(sum(map(len, ROWS)))  # where a walk starts
STEP_BITS, TURN_BITS, SHIFT_BITS = 0.5, 2.5, 1.0  # each further key; a new direction; a change between small and capital
WALK_KEYS = 3
UNITS = {1: 3, 2: 2, 3: 2, 4: 2}  # characters of a repeated unit, and how often it must stand


def case_bits(part: str) -> float:
    """Guesses for the capitals of a word: none, first or all are tried
    early, else any choice of as many positions."""
    upper = sum(c.isupper() for c in part)
    letters = sum(c.isalpha() for c in part)
    if not upper:
        return 0.0
    if upper == letters or (upper == 1 and part[0].isupper()):
        return 1.0
    return math.log2(sum(math.comb(letters, k) for k in range(1, min(upper, letters - upper) + 1)) + 1)


def char_bits(value: str) -> float:
    """Bits of one character found by brute force, from the kinds of
    characters that the value uses."""
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    size += 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(c.isascii() and not c.isalnum() for c in value) + 100 * any(not c.isascii() for c in value)
    return math.log2(max(size, 2))


def segments(value: str, words: Mapping[str, float]) -> dict[int, list[tuple[int, float]]]:
    """Words and dates by their end: ``{end: [(start, bits)]}``, found in time
    linear in the value.  ``words`` maps lower-case words to the bits of their
    rank; they may have up to ``WORD_BYTES`` letters, as those taken from a
    text have."""
    found: dict[int, list[tuple[int, float]]] = {}
    low = value.lower() if len(value.lower()) == len(value) else value
    plain, n = low.translate(LEET), len(value)

    def add(start: int, end: int, bits: float) -> None:
        found.setdefault(end, []).append((start, bits))

    for i in range(n):
        for j in range(i + 3, min(n, i + WORD_BYTES) + 1):
            for form, more in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                bits = words.get(form)
                if bits is not None:
                    add(i, j, bits + more + case_bits(value[i:j]))
                    break
        if m := YEAR.match(low, i):
            add(i, m.end(), math.log2(119))
        for form in DATES:
            if m := form.match(low, i):
                add(i, m.end(), math.log2(365 * 60) + (2.0 if m.group(1) else 0.0))
    return found


def guess_bits(value: str, words: Mapping[str, float]) -> float:
    """log2 of the guesses for ``value``: the cheapest way to cut it into
    words, dates, keyboard walks, repeats and brute-force spans, by dynamic
    programming over its prefixes.

    Each segment after the first adds ``SEGMENT_BITS``.  A brute-force span
    costs its characters.  A walk of ``WALK_KEYS`` keys or more costs its
    first key, ``STEP_BITS`` a further key, ``TURN_BITS`` each time its
    direction changes and ``SHIFT_BITS`` each time the case does.  A unit of
    up to four characters that repeats costs its characters and the log2 of
    how often.  Walks and repeats may begin at any character: those still
    open are states of the program.  Of the walks it keeps the cheapest by
    direction; of the repeats, those that are cheaper than every one begun
    before, as a later one only loses ground.  So the work is linear in the
    value however long its runs are.
    """
    n, each = len(value), char_bits(value)
    if not n:
        return 0.0
    found = segments(value, words)
    low = value.lower() if len(value.lower()) == n else value
    best, brute, closed = [0.0] + [math.inf] * n, [math.inf] * (n + 1), [0.0] + [math.inf] * n

    def begun(i: int) -> float:
        """A prefix of ``i`` characters with the price of one more segment."""
        return best[i] + (SEGMENT_BITS if i else 0.0)

    walks: dict[tuple[int, int], float] = {}  # (keys up to WALK_KEYS, direction): cheapest open walk ending here
    again: dict[int, dict[int, list[tuple[int, float]]]] = {u: {} for u in UNITS}  # open repeats (start, price) by unit and end's place
    same = dict.fromkeys(UNITS, 0)
    for j in range(1, n + 1):
        i, key = j - 1, low[j - 1]
        ends = [bits + begun(start) for start, bits in found.get(j, ())]
        # walks: one key more, or a first key
        move = NEAR.get(low[i - 1], {}).get(key) if i else None
        step: dict[tuple[int, int], float] = {}
        if move is not None:
            shift = SHIFT_BITS if value[i - 1].isupper() != value[i].isupper() and key.isalpha() and low[i - 1].isalpha() else 0.0
            for (keys, way), cost in walks.items():
                more = cost + STEP_BITS + shift + (TURN_BITS if way not in (-1, move) else 0.0)
                state = (min(keys + 1, WALK_KEYS), move)
                step[state] = min(step.get(state, math.inf), more)
        if key in NEAR:
            step[1, -1] = begun(i) + WALK_BITS
        walks = step
        ends += [cost for (keys, _), cost in walks.items() if keys == WALK_KEYS]
        # repeats: as long as the characters one unit back are the same
        for u, least in UNITS.items():
            same[u] = same[u] + 1 if j > u and key == low[i - u] else 0
            if not same[u]:
                again[u].clear()
            elif same[u] >= u * (least - 1):
                open_ = again[u].setdefault(j % u, [])
                start = j - least * u
                prices = [price + math.log2((j - at) / u) for at, price in open_]
                fresh = begun(start) + u * each
                if fresh + math.log2(least) < min(prices, default=math.inf):
                    open_.append((start, fresh))
                    prices.append(fresh + math.log2(least))
                ends += prices
        closed[j] = min(ends, default=math.inf)
        brute[j] = each + min(brute[i], closed[i] + (SEGMENT_BITS if i else 0.0))
        best[j] = min(closed[j], brute[j])
    return best[n]


COMMON_BITS = {w: math.log2(r + 1) + 1 for r, w in enumerate(COMMON)}
TEXT_WORD = re.compile(rb"[A-Za-z]{3,24}")


def scan(raw: bytes, min_bits: float = MIN_BITS, extra_words: Mapping[str, float] | None = None) -> list[Span]:
    """Spans of one text (byte offsets).  The score of ``assign`` and
    ``guess`` is the guess cost of the value; patterns alone score 0.

    ``guess`` spans are values in a credential context (outside the fixed
    patterns' spans) that cost at least ``min_bits``.  Words of the rest of
    the text are guessable as well: what reads like the prose around it is no
    secret.
    """
    low = raw.lower()
    found: list[Span] = []
    values: list[tuple[int, int, str]] = []
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(raw):
            if m.end(2) - m.start(2) >= 6:
                values.append((m.start(), m.end(), m.group(2).decode()))
    taken = [(a, b) for a, b, _ in values]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access", 0.0) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex", 0.0) for m in HEX.finditer(raw)]
    guesses = []
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(raw):
            value = m.group(1).rstrip(TRAILING)
            span = (m.start(1), m.start(1) + len(value))
            if len(value) >= 4 and not any(a < span[1] and span[0] < b for a, b in taken):
                guesses.append((*span, value.decode()))
    if values or guesses:
        words = dict(extra_words or {})
        rest, done = [], 0
        for a, b in sorted([*taken, *[g[:2] for g in guesses]]):
            rest.append(raw[done:a])
            done = b
        rest.append(raw[done:])
        own = {w.decode().lower() for part in rest for w in TEXT_WORD.findall(part)}
        cost = math.log2(len(own) + 1) + 1
        words |= {w: min(cost, words.get(w, math.inf)) for w in own}
        words |= {w: min(b, words.get(w, math.inf)) for w, b in COMMON_BITS.items()}
        found += [(a, b, "assign", guess_bits(v, words)) for a, b, v in values]
        found += [(a, b, "guess", bits) for a, b, v in guesses if (bits := guess_bits(v, words)) >= min_bits]
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS,
                 words: Mapping[str, float] | None = None) -> DataFrame:
    """``(id, spans)`` for every row of ``docs``; a span is (start, end, kind,
    score) in code points, ``score`` the guess cost in bits.

    Kinds: ``assign`` (a credential's name, a separator and a value of six or
    more characters), ``access`` (access key ids), ``hex`` (long runs of hex
    digits), each leftmost and non-overlapping over the whole text; and
    ``guess``, values in a wider credential context that would take
    ``2^min_bits`` guesses or more.  ``words`` adds guessable words (lower
    case, with their bits).  Null and empty texts have no spans; repeated
    rows are scanned as often as they occur; other columns do not matter.
    No shuffle.
    """
    return scan_texts(docs, id_col, text_col, lambda raw: scan(raw, min_bits, words), KINDS)
