"""Packing against a plain search over all bins."""

import random

import pytest
from pyspark.sql import functions as F

from logtab.llm import packing as pk


def slow_best_fit(pieces, capacity):
    bins, out = [], []
    for size, source, cluster in pieces:
        fit = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and (source < 0 or source not in b[1])
               and (cluster < 0 or cluster not in b[2])]
        if fit:
            i = min(fit)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
    return out


def test_best_fit():
    rng = random.Random(2)
    for _ in range(40):
        pieces = sorted(((rng.randrange(1, 60), rng.randrange(-1, 5), rng.choice([-1, -1, 0, 1, 2])) for _ in range(120)), reverse=True)
        assert pk.best_fit(*zip(*pieces), 100) == slow_best_fit(pieces, 100)


def make(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000]), rng.choice(["hot", "hot", "a", "b", None]),
             rng.choice([1, 2, 3, None])) for i in range(500)]
    rows += [(None, 30, "a", 1), (None, 30, "a", 1), (7, 30, "a", 1), (7, 30, "a", 1), (501, None, "a", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, length long, source string, bin long")


def test_pack(spark):
    rows, df = make(spark)
    got = pk.pack(df, "doc_id", F.col("length"), F.col("source"), F.col("bin"), capacity=100, shard_pieces=100).collect()
    want = sorted((i, p, s, min(100, n - s)) for i, n, _, _ in rows if n for p, s in enumerate(range(0, n, 100)) if i is not None)
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 2
    meta = {i: (s, c) for i, _, s, c in rows}
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert held[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(held, held[1:]))
        assert held[-1].offset + held[-1].length <= 100
        for k in (0, 1):  # partial pieces conflict by source and cluster
            marks = [meta[r.doc_id][k] for r in held if r.doc_id in meta and meta[r.doc_id][k] is not None]
            assert len(marks) == len(set(marks))
    assert len({b.split("-")[0] for b in bins if b[0] == "s"}) > 3
    tight = len([b for b in bins if b[0] == "s"])
    assert tight < sum(1 for r in got if r.length < 100)


def test_empty_and_helpers(spark):
    _, df = make(spark)
    none = pk.pack(df.limit(0), "doc_id", F.col("length"), F.col("source"), F.col("bin"))
    assert none.columns == ["doc_id", "piece", "start", "length", "bin", "offset"] and none.count() == 0
    with pytest.raises(ValueError):
        pk.pack(df, "doc_id", F.col("length"), F.col("source"), F.col("bin"), capacity=0)
    t = spark.createDataFrame([("a  B\n\x0bc\x85d",), ("",), (None,)], "text string")
    assert [r[0] for r in t.select(pk.word_count(F.col("text"))).collect()] == [3, 0, 0]
    same = spark.createDataFrame([("A b",), ("a\nB",), ("a c",)], "text string").select(pk.text_cluster(F.col("text"))).collect()
    assert same[0] == same[1] != same[2]
