"""Line deduplication against a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logtab.llm import linededup as ld


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, line, edits):
    s = list(line)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.choice("ids")
        if kind == "i":
            s.insert(at, rng.choice("abcé😀 "))
        elif at < len(s):
            if kind == "d":
                del s[at]
            else:
                s[at] = rng.choice("abcé😀 ")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc"), ("aaaa", "aaab"), ("😀é", "é😀")]
    for _ in range(150):
        a = "".join(rng.choices("abé😀", k=rng.choice([1, 2, 3, 5, 9, 30])))
        pairs.append((a, mutate(rng, a, rng.randrange(6))))
        pairs.append((a, "".join(rng.choices("abé😀", k=len(a)))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.d for r in ld.with_distance(df, "a", "b", edits, "d").collect()}
    for i, (a, b) in enumerate(pairs):
        d = edit(a, b)
        assert got.get(i) == (d if d <= edits else None), (a, b, d)


def test_distance_walks_whole_strings(spark):
    """The band itself, without the cutting of common ends."""
    rng = random.Random(9)
    pairs = [("".join(a), "".join(b)) for _ in range(150) for a in [rng.choices("ab", k=rng.randrange(12))]
             for b in [mutate(rng, "".join(a), 3)] if abs(len(a) - len(b)) <= 2]
    df = spark.createDataFrame(pairs, "a string, b string")
    chars = [F.expr(f"regexp_extract_all({c}, '(?s).', 0)") for c in "ab"]
    for r in df.withColumn("d", ld.banded_distance(*chars, 2)).collect():
        d = edit(r.a, r.b)
        assert (r.d == d) if d <= 2 else r.d > 2, (r.a, r.b, d, r.d)


def test_probes_cover_every_pair():
    """Any string within the edits shares a probed substring with an indexed
    segment (checked on the places alone)."""
    rng = random.Random(2)
    for edits in (1, 2, 3):
        for _ in range(400):
            base = "".join(rng.choices("ab", k=rng.randrange(24, 60)))
            other = mutate(rng, base, edits)
            short, long = sorted((base, other), key=len)
            n, parts = len(short), edits + 1
            size, extra = divmod(n, parts)
            found = False
            for i in range(parts):
                at = i * size + max(0, i - (parts - extra))
                width = size + (i >= parts - extra)
                for s in ld.probe_shifts(len(long) - n, i, edits):
                    found |= long[at + s:at + s + width] == short[at:at + width]
            assert found


def brute(rows, edits=2, min_chars=24):
    ws = " \t\n\x0b\x0c\r"
    key = {}
    lines = []
    for n, (i, h, text) in enumerate(rows):
        for p, raw in enumerate((text or "").split("\n") if text is not None else []):
            if raw.strip(ws):
                lines.append(((i is None, i if i is not None else 0, h, p), raw.strip(ws), n, p))
    lines.sort(key=lambda x: x[0])
    first = {}
    for at, t, n, p in lines:
        first.setdefault(t, at)
    long = [t for t in first if len(t) >= min_chars]
    near = {}
    for t in long:
        links = sum(first[o] < first[t] and o != t and abs(len(o) - len(t)) <= edits and edit(o, t) <= edits for o in long)
        if links:
            near[t] = links
    out = []
    for n, (i, h, text) in enumerate(rows):
        if text is None:
            out.append((i, None, 0, 0, 0, 0))
            continue
        mine = [x for x in lines if x[2] == n]
        gone = {x[3]: x[1] in near for x in mine if x[1] in near or first[x[1]] != x[0]}
        kept = [raw for p, raw in enumerate(text.split("\n")) if p not in gone]
        out.append((i, "\n".join(kept), len(text.split("\n")), sum(not v for v in gone.values()), sum(gone.values()),
                    sum(near[x[1]] for x in mine if x[3] in gone and gone[x[3]])))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcdefg é", k=rng.choice([3, 10, 25, 40, 41, 90]))) for _ in range(40)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            parts.append(rng.choice([line, line, mutate(rng, line, rng.randrange(4)), " " + line + "\t\r", "", "  "]))
        texts.append("\n".join(parts))
    texts += [None, "", "\n\n", texts[0], texts[1] * 2, "x" * 700, "x" * 699 + "y"]
    ids = [rng.choice([*range(1000, 1060), None]) for _ in texts]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, pos string").repartition(4)
    keyed = df.select("doc_id", ld.row_key(F.col("text")).alias("h"), "text").collect()
    got = ld.dedup_lines(df, counts=True)
    assert got.columns == ["doc_id", "text", "pos", "n_lines", "n_repeats", "n_near", "n_links"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_repeats, r.n_near, r.n_links) for r in got.collect()), key=repr)
    want = sorted(brute([(r.doc_id, r.h, r.text) for r in keyed]), key=repr)
    assert got == want
    assert sum(r[4] for r in want) > 10


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_segments(spark, crowd):
    """Many lines of one length with the same beginning: only those within
    the edits are linked, whatever is crowded."""
    rng = random.Random(5)
    head = "".join(rng.choices("abcdef ", k=40)).strip()
    lines = []
    for _ in range(60):
        tail = "".join(rng.choices("abcdefghijkl", k=25))
        lines += [head + tail, mutate(rng, head + tail, rng.choice([1, 2, 3]))]
    rows = [(i, "\n".join(lines[i::12])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", ld.row_key(F.col("text")).alias("h")).collect()}
    got = sorted(tuple(r) for r in ld.dedup_lines(df, counts=True, crowd=crowd).collect())
    assert got == sorted(brute([(i, hashes[i], t) for i, t in rows]))
    assert sum(r[4] for r in got) > 30


def test_letter_counts_bound_the_edits(spark):
    rng = random.Random(8)
    pairs = [(a, mutate(rng, a, 2)) for a in ("".join(rng.choices("abczé ", k=30)) for _ in range(50))]
    counted = spark.createDataFrame(pairs, "a string, b string").select(
        ld.letter_counts(F.col("a")).alias("x"), ld.letter_counts(F.col("b")).alias("y")).collect()
    assert all(sum(abs(i - j) for i, j in zip(r.x, r.y)) <= 4 for r in counted)
    assert [r.x[0] for r in counted] == [a.count("a") for a, _ in pairs]


def test_long_lines(spark):
    long = "".join(random.Random(4).choices("abcd ef", k=60_000)).strip()
    rows = [(1, long), (2, long[:20_000] + "Q" + long[20_001:]), (3, long[:9] + "QRS" + long[9:]), (4, "z" + long[:-1])]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: long, 2: "", 3: rows[2][1], 4: ""}


def test_empty_table_and_limits(spark):
    df = spark.createDataFrame([], "doc_id long, text string, line string, h1 int")
    out = ld.dedup_lines(df)
    assert out.columns == df.columns and out.count() == 0
    with pytest.raises(ValueError):
        ld.near_lines(df, df, min_chars=5)


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = ld.dedup_lines(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_generated_methods_are_compiled(spark, monkeypatch):
    """The JVM interprets methods of more than 8,000 bytes for ever: no step
    may generate one (the probes' keys did, with 11,638)."""
    sizes = {}
    write = ld.materialise

    def noted(df, label):
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        code = getattr(debug, "MODULE$").codegenString(df._jdf.queryExecution().executedPlan())
        sizes[label] = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        return write(df, label)

    monkeypatch.setattr(ld, "materialise", noted)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code before it runs
    try:
        noted(ld.dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), counts=True), "out")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes["line-met"] and max(max(s) for s in sizes.values() if s) <= 8000, sizes
