"""Embedding links against all pairs in double precision."""

import math
import random

import numpy as np
import pytest

from logtab.llm import embeddings as em

SCHEMA = "vec_id long, embedding array<float>, n int"


def brute(rows, threshold):
    good = {}
    for i, (_, v, _) in enumerate(rows):
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[i] = x / np.linalg.norm(x)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(good)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            if len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    group = {}
    for i, (vid, _, _) in enumerate(rows):
        if vid is not None:
            group[find(i)] = min(vid, group.get(find(i), vid))
    return sorted([(vid, links[i], group.get(find(i))) for i, (vid, _, _) in enumerate(rows)], key=repr)


def make(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 14))):
            v = centre + rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.4])
            rows.append((v * rng.choice([1, 1, 1e-3, 50])).astype(np.float32).tolist())
    rows += [None, [], [0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1),
             [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, -0.0, 1.0], [-0.0, 0.0, 1.0]]
    ids = random.Random(seed).sample(range(5000), len(rows))
    out = [(i, v, 1) for i, v in zip(ids, rows)]
    return out + [(None, rows[0], 2), (ids[5], rows[9], 2), (ids[0], rows[0], 2)]


@pytest.mark.parametrize("threshold", [0.9, 0.97])
def test_matches_brute_force(spark, threshold):
    rows = make(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = em.near_vectors(df, threshold=threshold, tile=40).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == brute(rows, threshold)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 1500)) * rng.choice([0.01, 1, 30], size=(300, 1500))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, norm, err = em.quantise(x)
    whole = codes.astype(np.int64) @ codes.astype(np.int64).T
    assert np.array_equal(em.products(codes, codes), whole)
    off = np.abs(x @ x.T - whole * np.outer(scale, scale))
    assert (off <= np.outer(norm, err) + np.outer(err, norm) + np.outer(err, err) + em.SLACK).all()


def test_span():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 300, (2, 220))
    label = np.arange(300)
    em.span(label, x, y)
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(x.tolist(), y.tolist()):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert label.tolist() == [find(i) for i in range(300)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, tile int")
    out = em.near_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0
    with pytest.raises(ValueError):
        em.near_vectors(df, threshold=0)
