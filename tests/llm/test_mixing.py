"""Raking against a NumPy version; calibration and draws."""

import random

import numpy as np
from pyspark.sql import functions as F

from logtab.llm import mixing as mx


def make(spark, n=600):
    rng = random.Random(5)
    rows = [(i, i * 7, rng.choice(["hot"] * 3 + ["a", "b", None]), rng.choice(["en", "en", "de"]), rng.randrange(3),
             rng.choice([0, 10, 50, 400])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, key long, source string, lang string, topic int, tokens long")


def slow_rake(rows, exponents):
    cells = {}
    for _, _, s, l, t, n in rows:
        cells[s, l, t] = cells.get((s, l, t), 0) + n
    cells = {k: v for k, v in cells.items() if v}
    total = sum(cells.values())
    goal = []
    for d, e in enumerate(exponents):
        share = {}
        for k, v in cells.items():
            share[k[d]] = share.get(k[d], 0) + v
        power = {k: v ** e for k, v in share.items()}
        goal.append({k: v * total / sum(power.values()) for k, v in power.items()})
    w = {k: 1.0 for k in cells}
    for _ in range(200):
        for d in range(3):
            now = {}
            for k, v in cells.items():
                now[k[d]] = now.get(k[d], 0) + v * w[k]
            w = {k: w[k] * goal[d][k[d]] / now[k[d]] for k in w}
    return cells, w


def test_rake_and_draw(spark):
    rows, df = make(spark)
    cells, w = slow_rake(rows, [0.7, 0.7, 0.5])
    targets = {d: mx.tempered(df, d, e) for d, e in mx.EXPONENTS.items()}
    got = {(r.source, r.lang, r.topic): r for r in mx.rake(df, targets, tolerance=1e-5).collect()}
    assert got.keys() == cells.keys()
    for k, r in got.items():
        assert r.tokens == cells[k] and abs(r.weight - w[k]) < 1e-3 * w[k]
    out = mx.mixed(df, keep=0.8, tolerance=1e-5)
    drawn = out.collect()
    assert out.columns == [*df.columns, "probability", "kept"] and len(drawn) == len(rows)
    expected = sum(r.probability * r.tokens for r in drawn)
    assert abs(expected - 0.8 * sum(cells.values())) < 1e-6 * expected
    free = [(r.probability / w[r.source, r.lang, r.topic]) for r in drawn if r.tokens and r.probability < 1]
    assert np.ptp(free) < 1e-3 * free[0]  # one factor for all that is not certain
    assert all(w[r.source, r.lang, r.topic] * free[0] > 0.999 for r in drawn if r.tokens and r.probability == 1)
    again = {r.id: r.kept for r in mx.mixed(df.repartition(7), keep=0.8, tolerance=1e-5).collect()}
    assert again == {r.id: r.kept for r in drawn}
    assert abs(np.mean([r.kept for r in drawn]) - np.mean([r.probability for r in drawn])) < 0.06


def test_given_targets(spark):
    _, df = make(spark, 200)
    goal = spark.createDataFrame([("hot", 1.0), ("a", 3.0), ("absent", 9.0)], "value string, target double")
    cells = mx.rake(df, {"source": goal}).collect()
    share = {r.source: r.tokens * r.weight for r in cells}
    assert abs(share["a"] / share["hot"] - 3) < 1e-9 and share[None] == 0 and share["b"] == 0


def test_profile_and_sample(spark):
    rows = [(1, "Alphas betas ALPHAS x", "en", "s"), (2, "a b c", None, None), (3, None, "de", "s"), (3, None, "de", "s"), (None, "gammas", "de", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("x"))
    got = {(r.id, r.source): r for r in mx.profile(df).collect()}
    assert got[1, "s"].tokens == 4 and got[2, None].topic == -1 and got[3, "s"].tokens == 0
    assert mx.topic_word(b"Alphas betas ALPHAS x betass betass") == b"alphas"
    out = mx.sample_mixture(df, keep=1.0)
    assert out.columns == df.columns
    none = mx.sample_mixture(df.limit(0))
    assert none.columns == df.columns and none.count() == 0


def test_drawn_marginals_meet_targets(spark):
    """Also where the targets ask for more of a category than there is."""
    rng = random.Random(8)
    rows = [(i, i * 7, rng.choice(["hot"] * 8 + ["a", "b"]), rng.choice(["en"] * 6 + ["de"]), rng.randrange(3), rng.randrange(1, 9))
            for i in range(20000)]
    df = spark.createDataFrame(rows, "id long, key long, source string, lang string, topic int, tokens long")
    goal = {"source": {"hot": 0.4, "a": 0.35, "b": 0.25}, "lang": {"en": 0.6, "de": 0.4}}
    targets = {d: spark.createDataFrame(list(g.items()), "value string, target double") for d, g in goal.items()}
    drawn = mx.mixed(df, targets=targets, repeats=True).collect()
    assert max(r.kept for r in drawn) > 1
    assert all(r.kept in (int(r.probability), int(r.probability) + 1) for r in drawn)
    for number, within in (("probability", 1e-3), ("kept", 0.03)):
        total = sum(r[number] * r.tokens for r in drawn)
        assert abs(total / sum(r.tokens for r in drawn) - mx.KEEP) < within
        for d, g in goal.items():
            for value, share in g.items():
                assert abs(sum(r[number] * r.tokens for r in drawn if r[d] == value) / total - share) < within * share, (number, value)


def test_sample_repeats_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 10, "en", "big" if i % 10 else "rare") for i in range(200)],
                                 "doc_id long, text string, lang string, source string")
    goal = {"source": spark.createDataFrame([("big", 1.0), ("rare", 1.0)], "value string, target double")}
    want = {r.id: r.kept for r in mx.mixed(mx.profile(docs), targets=goal, repeats=True).collect()}
    got = {r.doc_id: r["count"] for r in mx.sample_mixture(docs, targets=goal, repeats=True).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n} and all(want[i] >= 4 for i in range(0, 200, 10))
