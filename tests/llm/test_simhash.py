"""SimHash groups against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash

from logtab.llm import simhash
from logtab.llm.components import components

SCHEMA = "doc_id long, text string"


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, max_bits=3):
    fps = {i: brute_fp(t) for i, t in rows}
    comp = {i: i for i in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def sample_docs():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "x y", "İz", "AKIA"]
    rows = []
    for i in range(25):
        words = rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 40, 200]))
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            edited = list(words)
            edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rows.append(rng.choice([" ", "\n", "\t "]).join(edited))
    rows += ["", None, " \t\n\x0b\x0c\r ", rows[0], rows[0].upper(), "one", "ONE"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def test_matches_brute_force(spark):
    rows = sample_docs()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(simhash.simhash_groups(df)) == want
    # groups past the size bound are dealt again and lose no link
    assert result(simhash.simhash_groups(df, group_rows=1)) == want
    # any number of blocks beyond max_bits gives the same groups
    assert result(simhash.simhash_groups(df, blocks=4)) == want


def test_group_spans_batches():
    """A group cut over many Arrow batches keeps its links."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = int(rng.integers(1, 1 << 60))
    fps = [base ^ (1 << int(b)) for b in range(40)]
    cols = [[0] * 40 + [1] * 3, [7] * 40 + [9] * 3, fps + [1, 0xFF0 << 40, 3], list(range(43))]
    whole = pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=list("cbfr"))
    for size in (1, 3, 41, 43):
        parts = [whole.slice(i, size) for i in range(0, 43, size)]
        out = [r for b in simhash.link_groups(iter(parts), 3, 4096) for r in b.to_pylist()]
        seen = {r for row in out for r in (row["a"], row["b"])}
        assert seen == set(range(40)) | {40, 42} and len(out) == 40
        over = [r for b in simhash.link_groups(iter(parts), 3, 10) for r in b.to_pylist()]
        assert {r["a"] for r in over if r["b"] is None} == set(range(40))
        assert [(r["a"], r["b"]) for r in over if r["b"] is not None] == [(40, 42)]


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"v{i % 97}" for i in range(500))
    want = simhash.fingerprint(text.encode())
    assert want % (1 << 64) == brute_fp(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == want


def test_edge_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (None, "only here q", "z"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "fp")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2)], key=str)
    empty = simhash.simhash_groups(df.limit(0))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e", "k"), (1, "A b c d e", "l"), (None, "a b c d e", "m"), (9, "other words in here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {1, None, 9}


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 200
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(150, i) for i in range(n)],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)], "empty": []}[shape]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    loops = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    want = {x: find(x) for x in parent if x not in loops}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
