"""Line deduplication: exact copies and a segment-partition edit join.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import SPACE, materialise, row_key, same, settled, sieve

MAX_EDITS = 2
MIN_CHARS = 24
CROWD = 8


def trimmed(line: Column) -> Column:
    """The line without white space at its ends (the set-based trim walks
    whole lines, so it only runs where an end is white space)."""
    ends = [F.substring(line, 1, 1), F.substring(line, -1, 1)]
    return F.when(ends[0].isin(*SPACE) | ends[1].isin(*SPACE), F.btrim(line, F.lit(SPACE))).otherwise(line)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, pos, line, h1, h2)`` of every line that has a word; ``h1``
    and ``h2`` are two 64-bit hashes of the trimmed line, 128 bits together."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    split = rows.select("id", row_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return (split.select("id", "key", "pos", trimmed(F.col("raw")).alias("line")).where("line <> ''")
            .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line")))


def place() -> Column:
    """Where a line stands: order of documents, then of lines; rows without
    an id come last."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("key"), F.col("pos"))


# --- candidates: segments indexed by length, substrings probed -------------

CODE = 4  # bytes of a character


def coded(line: Column) -> Column:
    """The line with every character in four bytes, so that lengths and
    substrings take no walk over its characters."""
    return F.encode(line, "UTF-32")


def segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a line of ``length``
    characters cut into ``edits + 1`` parts, the longer ones last."""
    parts = edits + 1
    size, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    first_long = F.lit(parts) - extra
    return i * size + F.greatest(F.lit(0), i - first_long), size + (i >= first_long).cast("int")


def probe_shifts(shorter: int, i: int, edits: int) -> range:
    """Where segment ``i`` of a line ``shorter`` characters shorter can lie
    in the probing line, relative to its own start, if at most ``i`` edits
    are spent before it and ``edits - i`` after it."""
    return range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1)


def index_cuts(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter, i, shift)`` of a line's own segments."""
    return [(0, i, 0) for i in range(edits + 1)]


def probe_cuts(edits: int) -> list[tuple[int, int, int]]:
    """``(shorter, i, shift)`` of every place where a segment of an equal or
    shorter line can lie."""
    return [(shorter, i, shift) for shorter in range(edits + 1) for i in range(edits + 1)
            for shift in probe_shifts(shorter, i, edits)]


def keyed(lines: DataFrame, name: str, cuts: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """``(name, part)`` for every cut of every line.

    The cuts are exploded before the key is made, so that its code stands
    once in the generated method: one copy for each cut makes the method
    too long for the JVM to compile (8,000 bytes), and it is interpreted."""
    sized = lines.select(F.col("h1").alias(name), coded(F.col("line")).alias("code"))
    sized = sized.select(name, "code", F.expr(f"octet_length(code) div {CODE}").cast("int").alias("n"))
    each = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("shorter", "i", "shift"), cut)]) for cut in cuts])
    cut = sized.select(name, "code", "n", F.explode(each).alias("cut"))
    length, i = F.col("n") - F.col("cut.shorter"), F.col("cut.i")
    start, size = segment(length, i, edits)
    part = F.substring(F.col("code"), (start + F.col("cut.shift")) * CODE + 1, size * CODE)
    return cut.select(name, F.xxhash64(length, i, part).alias("part"))


def letter_counts(line: Column) -> Column:
    """How often each letter a-z stands in the line."""
    n = F.char_length(line)
    return F.array(*[n - F.char_length(F.replace(line, F.lit(c), F.lit(""))) for c in string.ascii_lowercase])


def candidates(lines: DataFrame, edits: int, crowd: int) -> DataFrame:
    """Distinct pairs of line hashes ``(a, b)``, ``a < b``, that share a
    segment and may be within ``edits``.

    A segment in more than ``crowd`` index lines (a phrase that begins very
    many lines of one length) is crowded.  Its lines meet under a second key:
    within that many edits the counts of the letters differ by ``2 * edits``
    in all, so of one more group of letters than that one has the same counts
    on both sides.  Lines that meet there must also agree in all letters but
    so many, or they are no candidates.
    """
    index = materialise(keyed(lines, "a", index_cuts(edits), edits), "line-index")
    full = materialise(index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("part"), "line-crowds")
    # a crowded segment stands in the index once: who probes it is noted, not paired
    few = index.join(full, "part", "left_anti").unionByName(full.withColumn("a", F.lit(None).cast("long")))
    met = few.join(keyed(lines, "b", probe_cuts(edits), edits), "part").where("a is null or a <> b")
    met = materialise(met.select("a", "b", F.when(F.col("a").isNull(), F.col("part")).alias("part")), "line-met")

    many_index, many_probe = index.join(full, "part", "left_semi"), met.where("a is null").select("part", "b")
    met = met.where("a is not null").select("a", "b")
    ids = materialise(many_index.select(F.col("a").alias("h1")).union(many_probe.select("b")).distinct(), "line-crowd-ids")
    marked, maybe = sieve(lines, F.col("h1"), ids)
    counted = (marked.where(maybe).select("h1", "line").join(ids, "h1", "left_semi")
               .select("h1", letter_counts(F.col("line")).alias("letters")))
    counted = materialise(counted, "line-letters")
    groups = 2 * edits + 1

    def by_letters(rows: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(g), *[F.get("letters", F.lit(i)) for i in range(g, 26, groups)]) for g in range(groups)])
        return (rows.join(counted.withColumnRenamed("h1", name), name)
                .select("part", name, F.col("letters").alias(f"{name}_letters"), F.explode(keys).alias("same")))

    apart = F.aggregate(F.zip_with("a_letters", "b_letters", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d)
    dense = (by_letters(many_index, "a").join(by_letters(many_probe, "b"), ["part", "same"])
             .where((F.col("a") != F.col("b")) & (apart <= 2 * edits)).select("a", "b"))
    return met.union(dense).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- verification ------------------------------------------------------------

def common_run(a: Column, b: Column, most: Column, from_end: bool) -> Column:
    """Length of the common prefix (suffix) of two strings, ``most`` at most:
    a descent over powers of two that compares one slice per step."""

    def slice_of(s: Column, done: Column, step: Column) -> Column:
        at = F.char_length(s) - done - step if from_end else done
        return s.substr(at + 1, step)

    def descend(done: Column, step: Column) -> Column:
        fits = (done + step <= most) & (slice_of(a, done, step) == slice_of(b, done, step))
        return F.when(fits, done + step).otherwise(done)

    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)),
                        lambda e: F.pow(F.lit(2), e).cast("int"))
    return F.aggregate(steps, F.lit(0), descend)


def bind(value: Column, body) -> Column:
    """A let-binding: evaluates ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters whose sizes differ by at
    most ``edits``: exact up to ``edits``, some larger number beyond.

    Bit-parallel over a diagonal band: bit ``o`` of a word stands for row
    ``j - edits + o`` of column ``j``; ``vp`` and ``vn`` hold the rises and
    falls down a column.  The score follows the band's lower edge until the
    last row and that row from there on.  Once the whole column is beyond
    ``edits`` the walk stands still.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    n_a = F.size(a)

    def column(acc: Column, j: Column) -> Column:
        vp, vn, char = acc["vp"], acc["vn"], F.get(b, j - 1)
        match = F.lit(0)
        for o in range(width):
            met = F.coalesce(F.get(a, j + (o - edits - 1)) == char, F.lit(False))
            match = match + F.when(met, F.lit(1 << o)).otherwise(F.lit(0))
        d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return F.struct(vp.alias("vp"), vn.alias("vn"), acc["score"].alias("score"), d0.alias("d0"), j.alias("j"))

    def rises(s: Column) -> Column:
        hp = s["vn"].bitwiseOR(s["d0"].bitwiseOR(s["vp"]).bitwiseXOR(F.lit(full)))
        hn = s["d0"].bitwiseAND(s["vp"])
        return F.struct(s["score"].alias("score"), s["d0"].alias("d0"), s["j"].alias("j"), hp.alias("hp"), hn.alias("hn"))

    def settle(s: Column) -> Column:
        low = F.shiftright(s["d0"], 1)
        vp = s["hn"].bitwiseOR(low.bitwiseOR(s["hp"]).bitwiseXOR(F.lit(full)))
        vn = low.bitwiseAND(s["hp"])
        row = F.pow(F.lit(2), n_a - s["j"] + edits).cast("int")  # the last row's bit
        step = (F.when(s["j"] + edits <= n_a, F.when(s["d0"].bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0))
                .otherwise((s["hp"].bitwiseAND(row) != 0).cast("int") - (s["hn"].bitwiseAND(row) != 0).cast("int")))
        return F.struct(vp.alias("vp"), vn.alias("vn"), (s["score"] + step).alias("score"))

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"), F.lit(0).alias("vn"),
                     F.least(n_a, F.lit(edits)).alias("score"))
    def step_on(acc: Column, j: Column) -> Column:
        # no cell of the column is below score - rises, and cells only grow along a path
        alive = acc["score"] - F.bit_count(acc["vp"]) <= edits
        return F.when(alive, bind(bind(column(acc, j), rises), settle)).otherwise(acc)

    columns = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(columns, start, step_on, lambda acc: acc["score"])


def letters_apart(a: Column, b: Column) -> Column:
    """Sum over a-z of how often each letter stands more in one string than
    in the other: at most twice the edit distance."""
    def times(s: Column, letter: str) -> Column:
        return F.char_length(s) - F.char_length(F.replace(s, F.lit(letter), F.lit("")))

    total = F.lit(0)
    for letter in string.ascii_lowercase:
        total = total + F.abs(times(a, letter) - times(b, letter))
    return total


def with_distance(pairs: DataFrame, a: str, b: str, edits: int, name: str) -> DataFrame:
    """Rows of ``pairs`` within ``edits``, with their edit distance as
    ``name`` in place of the two strings.

    Common ends are cut off first, which leaves the distance as it is; what
    lies between them is walked unless its letter counts alone are too far
    apart.  Each step is written before the next: a filter on a computed
    column would otherwise be pushed below and compute it again for each use.
    """
    la, lb = F.char_length(a), F.char_length(b)
    cut = pairs.withColumn("__pre", common_run(F.col(a), F.col(b), F.least(la, lb), False))
    cut = cut.withColumn("__suf", common_run(F.col(a), F.col(b), F.least(la, lb) - F.col("__pre"), True))
    for s, mid in ((a, "__ma"), (b, "__mb")):
        n = F.char_length(s) - F.col("__pre") - F.col("__suf")
        cut = cut.withColumn(mid, F.col(s).substr(F.col("__pre") + 1, n))
    cut = materialise(cut.drop("__pre", "__suf", a, b), "line-cuts")
    na, nb = F.char_length("__ma"), F.char_length("__mb")
    close = cut.where((F.abs(na - nb) <= edits) & (letters_apart(F.col("__ma"), F.col("__mb")) <= 2 * edits))
    chars = [F.when(F.char_length(m) > 0, F.regexp_extract_all(m, F.lit("(?s)."), 0)).otherwise(F.array().cast("array<string>"))
             for m in ("__ma", "__mb")]
    walked = bind(F.struct(chars[0].alias("a"), chars[1].alias("b")), lambda s: banded_distance(s["a"], s["b"], edits))
    return materialise(close.withColumn(name, walked).drop("__ma", "__mb"), "line-distances").where(F.col(name) <= edits)


# --- the operator --------------------------------------------------------------

def repeated_lines(occurrences: DataFrame) -> DataFrame:
    """``(h1, h2, first)`` of lines that stand in more than one place."""
    return (occurrences.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first"))
            .where("n > 1").select("h1", "h2", "first"))


def near_lines(lines: DataFrame, repeated: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
               crowd: int = CROWD) -> DataFrame:
    """``(h1, h2, to_h1, to_h2, distance)``: every pair of different lines of
    at least ``min_chars`` characters within ``max_edits`` edits, the later
    line first.  ``lines`` are those of ``lines_of``, ``repeated`` those of
    ``repeated_lines``.

    Lines are cut into ``max_edits + 1`` segments: within that many edits
    one segment survives whole, near its old place.  Each distinct line
    enters the index under its segments (with its length) and probes with
    its own substrings where a segment of an equal or shorter line can lie;
    equal hashes make candidates (see ``candidates``).  Only hashes are
    shuffled.  The texts of candidate lines alone are then fetched and
    verified.
    """
    if min_chars < (max_edits + 1) * (2 * max_edits + 1):
        raise ValueError("min_chars must leave each segment more than twice max_edits characters")
    every = lines.where(F.char_length("line") >= min_chars)
    marked, maybe = sieve(every, F.col("h1"), repeated.select("h1"))
    single = marked.where(~maybe).select("h1", "line")
    # one copy each of the lines that (may) repeat
    folded = materialise(marked.where(maybe).groupBy("h1", "h2").agg(F.first("line").alias("line")).select("h1", "line"), "lines-folded")
    pairs = materialise(candidates(single.union(folded), max_edits, crowd), "line-pairs")

    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct(), "line-ids")
    marked, maybe = sieve(every, F.col("h1"), wanted)
    found = marked.where(maybe).join(wanted, "h1", "left_semi")
    texts = materialise(found.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(place()).alias("first")), "line-texts")

    def side(name: str, end: str) -> DataFrame:
        return texts.select(F.col("h1").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in ("h2", "line", "first")])

    checked = with_distance(pairs.join(side("l", "a"), "a").join(side("r", "b"), "b"), "l_line", "r_line", max_edits, "distance")
    left, right = [F.struct(F.col(f"{s}_first").alias("first"), F.col(h).alias("h1"), F.col(f"{s}_h2").alias("h2"))
                   for s, h in (("l", "a"), ("r", "b"))]
    return (checked.select(F.greatest(left, right).alias("late"), F.least(left, right).alias("early"), "distance")
                   .select("late.h1", "late.h2", F.col("early.h1").alias("to_h1"), F.col("early.h2").alias("to_h2"), "distance"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, crowd: int = CROWD) -> DataFrame:
    """``(id, key, removed)`` of every document that loses lines; ``removed``
    is an array of (position, near, links), ``links`` the number of earlier
    lines within ``max_edits``."""
    lines = materialise(lines_of(docs, id_col, text_col), "lines")
    occurrences = lines.drop("line")
    repeated = materialise(repeated_lines(occurrences), "lines-repeated")
    near = materialise(near_lines(lines, repeated, max_edits, min_chars, crowd)
                       .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("links")), "lines-near")
    judged = materialise(
        repeated.join(near, ["h1", "h2"], "full").select("h1", "h2", "first", F.coalesce("links", F.lit(0)).alias("links")), "lines-judged")
    marked, maybe = sieve(occurrences, F.col("h1"), judged.select("h1"))
    stood = marked.where(maybe).select("id", "key", "pos", "h1", "h2")
    gone = (stood.join(judged, ["h1", "h2"])
            .where((F.col("links") > 0) | ~F.coalesce(F.col("first") == place(), F.lit(True)))
            .select("id", "key", F.struct("pos", (F.col("links") > 0).alias("near"), "links").alias("line")))
    return materialise(gone.groupBy("id", "key").agg(F.collect_set("line").alias("removed")), "lines-removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS,
                min_chars: int = MIN_CHARS, counts: bool = False, crowd: int = CROWD) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``.

    A line is a part between ``\\n``; lines compare without white space at
    their ends, and lines without a word always stay.  In the order of
    (id, text hash, position) a line goes if an equal line stands earlier,
    or if any earlier line text is within ``max_edits`` edits of it (both of
    ``min_chars`` characters or more; shorter lines only by equality).  What
    stays keeps its bytes and order; a document may end up empty.

    With ``counts``, adds ``n_lines``, ``n_repeats`` (removed as equal),
    ``n_near`` (removed as near) and ``n_links`` (near pairs of its removed
    lines, as one line text each).

    Null texts stay null.  Rows without an id come last in the order.  Rows
    that repeat both id and text are one document: each keeps the same
    lines.  Other columns pass through whatever their names.
    """
    removed = settled(lambda: removed_lines(docs, id_col, text_col, max_edits, min_chars, crowd))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at_id, at_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*names).withColumn("__id", F.col(at_id).cast("long"))
    rows = rows.withColumn("__key", row_key(F.col(at_text).cast("string")))
    marked, maybe = sieve(rows.withColumn("__doc", F.xxhash64("__id", "__key")), F.col("__doc"),
                          removed.select(F.xxhash64("id", "key").alias("doc")))
    marked = marked.withColumn("__maybe", maybe).drop("__cell", "__bitmap", "__doc")
    none = F.lit(None).cast(removed.schema["removed"].dataType)
    touched = marked.where("__maybe").join(
        removed, same((F.col("__id"), F.col("id")), (F.col("__key"), F.col("key"))), "left").drop("id", "key")
    every = touched.unionByName(marked.where(~F.col("__maybe")).withColumn("removed", none))

    split = F.split(at_text, "\n")
    gone = F.col("removed")["pos"]
    left = F.array_join(F.filter(split, lambda _, i: ~F.array_contains(gone, i)), "\n")
    out = [(F.when(gone.isNull(), F.col(n)).otherwise(left) if n == at_text else F.col(n)).alias(c)
           for n, c in zip(names, docs.columns)]
    if counts:
        near = F.filter("removed", lambda r: r["near"])
        out += [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                F.coalesce(F.size("removed") - F.size(near), F.lit(0)).cast("long").alias("n_repeats"),
                F.coalesce(F.size(near), F.lit(0)).cast("long").alias("n_near"),
                F.coalesce(F.aggregate(near, F.lit(0).cast("long"), lambda s, r: s + r["links"]), F.lit(0)).cast("long").alias("n_links")]
    return every.select(*out)
