"""Quality rules against plain recounts and a NumPy version of the fit."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from logtab.llm import quality as ql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def recount(text):
    words = WORD.findall(text)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    held = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(held),
            sum(c in "!?" for c in text), sum("A" <= c <= "Z" for c in text), len(set(words)))


def test_counts():
    rng = random.Random(1)
    texts = ["", "a", "a b", "a b c", "a b c a b c", "x\n\n x\nx\n\x0b\nx", "é ü z # *", "a " * 70, "\x1c a\x85b"]
    texts += ["".join(rng.choices("ab \n\t#!A😀", k=rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert ql.text_stats(t.encode()) == recount(t), t


def test_chi2():
    assert abs(ql.chi2_point(0.05, 6) - 12.5916) < 1e-3 and abs(ql.chi2_point(0.025, 2) - 7.3778) < 1e-3


def make_docs():
    rng = random.Random(7)
    rows = []
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    for i in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None])
        words = rng.choices(vocab, k=rng.randrange(20, 300))
        kind = rng.random()
        if kind < 0.04:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.08:
            words = [w + rng.choice(["%%%", "***"]) for w in words]
        elif kind < 0.1:
            words = words[:3] * 60
        rows.append((i, " ".join(words).capitalize() + ".", lang, source, i % 3))
    return rows + [(None, None, None, None, 1), (5000, "", "en", "s1", 1), (1, rows[1][1], *rows[1][2:])]


def fit(x):
    """The operator's estimate on one array."""
    floors = np.array(list(ql.FEATURES.values())) ** 2

    def model(mean, cov):
        cov = cov + np.diag(np.maximum(floors - np.diag(cov), 0))
        return np.round(mean, 7), np.linalg.inv(cov)

    def dist(m):
        y = x - m[0]
        return np.maximum((y @ m[1] * y).sum(1), 0)

    grid = np.floor(x * 100 + 0.5)
    low = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    mid = low(grid)
    m = model(mid / 100, np.diag((1.4826 * low(np.abs(grid - mid)) / 100) ** 2))
    for _ in range(ql.C_STEPS):
        bins = np.floor(4 * np.log2(np.maximum(dist(m), 1e-6)))
        cut = np.sort(bins)[int(np.ceil(0.75 * len(x))) - 1]
        part = x[bins <= cut]
        cov = np.cov(part.T, bias=True)
        share = len(part) / len(x)
        if share < 1:
            cov *= share / (1 - ql.chi2_tail(ql.chi2_point(1 - share, ql.P), ql.P + 2))
        m = model(part.mean(0), cov)
    inside = ql.chi2_point(1 - ql.INLIER, ql.P)
    part = x[dist(m) <= inside]
    cov = np.cov(part.T, bias=True) * ql.INLIER / (1 - ql.chi2_tail(inside, ql.P + 2))
    return dist(model(part.mean(0), cov))


def test_verdicts(spark):
    rows = make_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int").repartition(5)
    got = ql.judged(df, min_group=100)
    per_row = {(r.id, r.key): r for r in got.collect()}
    stats = ql.statistics(df).select("id", "key", "lang", "source", "base_failed", *ql.transformed()).collect()
    assert len(stats) == len(rows) and got.count() == len(rows)
    size = {}
    for r in stats:
        size[r.lang, r.source] = size.get((r.lang, r.source), 0) + (not r.base_failed)
    pool = {}
    for (lang, _), n in size.items():
        if n < 100:
            pool[lang] = pool.get(lang, 0) + n
    cells = {}
    for r in stats:
        cell = (0, r.lang, r.source) if size[r.lang, r.source] >= 100 else (1, r.lang) if pool[r.lang] >= 100 else (2,)
        cells.setdefault(cell, []).append(r)
    assert {c[0] for c in cells} >= {0, 1}
    far = 0
    for members in cells.values():
        members = [r for r in members if not r.base_failed]
        if len(members) < 100:
            for r in members:
                assert per_row[r.id, r.key].distance is None and per_row[r.id, r.key].kept
            continue
        for r, d in zip(members, fit(np.array([[r[f"f{i}"] for i in range(ql.P)] for r in members]))):
            mine = per_row[r.id, r.key]
            assert abs(mine.distance - d) < 1e-3 * max(1, d)
            assert mine.kept == (mine.distance <= ql.chi2_point(ql.TAIL, ql.P))
            far += not mine.kept
    assert far > 20
    kept = ql.keep_good(df, min_group=100)
    assert kept.columns == df.columns
    assert kept.count() == sum(per_row[r.id, r.key].kept for r in stats)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, key int")
    assert ql.judged(df).count() == 0 and ql.keep_good(df).columns == df.columns
    one = spark.createDataFrame([(1, "w " * 60 + "x", "en", "s")], "doc_id long, text string, lang string, source string")
    assert one.count() == 1 and not ql.judged(one).first().kept  # repeats alone
    few = one.withColumn("text", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("w"), i))))
    assert ql.judged(few).first().kept and ql.judged(few).first().distance is None


def test_small_left_over_groups_are_judged(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = []

    def add(n, lang, source, mark=""):
        for _ in range(n):
            text = " ".join(w + mark for w in rng.choices(vocab, k=rng.randrange(80, 300)))
            rows.append((len(rows), text, lang, source))

    add(150, "en", "s1")
    add(20, "en", "s2")  # left over, of a large language
    add(15, None, "s1")  # left over, of small ones
    add(4, "es", None)
    add(3, "en", "s2", "%%%")
    add(3, "es", None, "%%%")
    add(1, None, "s1", "%%%")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    values = {r.id: r for r in ql.statistics(df).select("id", "lang", "base_failed", *ql.transformed()).collect()}
    assert not any(r.base_failed for r in values.values())
    got = {r.id: r for r in ql.judged(df, min_group=100).collect()}
    assert len(got) == len(rows)

    def expect(among):
        ids = [i for i in values if among(values[i])]
        return dict(zip(ids, fit(np.array([[values[i][f"f{k}"] for k in range(ql.P)] for i in ids]))))

    table, en = expect(lambda r: True), expect(lambda r: r.lang == "en")
    first = expect(lambda r: r.id < 150)
    for i, text, lang, source in rows:
        d = (first if i < 150 else en if lang == "en" else table)[i]
        assert abs(got[i].distance - d) < 1e-3 * max(1, d)
        assert got[i].kept == (d <= ql.chi2_point(ql.TAIL, ql.P))
    assert not any(got[i].kept for i, text, _, _ in rows if "%" in text)
