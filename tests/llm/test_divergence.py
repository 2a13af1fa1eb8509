"""Source divergence against a brute-force version."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from logtab.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top=50):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}

        def shares(counts):
            total = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in mine.items()}
        q = shares({t: sum(c[t] for c in mine.values()) for t in kept})
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            found = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", found, top)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:limit]
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def sample():
    rng = random.Random(11)
    vocab = [f"w{chr(97 + i)}" for i in range(26)] + ["Été", "ÉTÉ", "straße", "a-b", "x1y", "中文", "[z]"]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["web", "web", "web", "wiki", "books", None])
        words = rng.choices(vocab, weights=range(1, len(vocab) + 1), k=rng.choice([0, 1, 8, 60]))
        rows.append((i, rng.choice([" ", "\n", "7", "."]).join(words), lang, source))
    return rows + [(200, None, "en", "void"), (201, "", "xx", "solo"), (202, "once", "yy", "one"), (203, "only", "yy", "two"),
                   rows[0], rows[0]]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, small):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    bounds = {"block_bytes": 90, "merge_terms": 5, "cells": 4, "shards": 3} if small else {}
    assert result(dv.divergence(docs, min_docs=4, top=5, **bounds)) == brute(rows, 4, 5)


def test_extra_columns_and_empty_table(spark):
    rows = [(*r, 1, 2, 3) for r in sample()]
    docs = spark.createDataFrame(rows, SCHEMA + ", rank int, value int, term int")
    assert result(dv.divergence(docs, min_docs=3)) == brute([r[:4] for r in rows], 3)
    assert dv.divergence(docs.limit(0)).collect() == []


def test_long_text_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(dv, "PIECE_BYTES", 10)
    text = ("Abc1déf " * 500).encode().translate(dv.BLANKED)
    terms, term, _, counts, docs = dv.counted(text)
    whole = dv.inverted([text], np.zeros(1, np.int64))
    assert dict(zip(terms.take(term).to_pylist(), counts)) == {"abc": 500, "déf": 500} and docs.tolist() == [1, 1]
    assert dict(zip(whole[0].take(whole[1]).to_pylist(), whole[3])) == {"abc": 500, "déf": 500} and whole[4].tolist() == [1, 1]


def test_merge_joins_equal_terms():
    def one(term, docs, *pairs):
        return (term, docs, np.array(list(pairs), dv.POSTING).tobytes())

    a, b = [one(b"a", 1, (0, 1)), one(b"b", 1, (0, 2))], [one(b"a", 3, (1, 1), (0, 5))]
    for most in (0, 100):
        got = [(t, d, dv.summed(raw).tolist()) for t, d, raw in dv.merged([a, b, []], most)]
        assert got == [(b"a", 4, [(0, 6), (1, 1)]), (b"b", 1, [(0, 2)])]
    assert list(dv.merged([])) == []


def test_share_is_exact_for_large_counts():
    rng = random.Random(1)
    totals = [rng.randrange(10**k, 10**(k + 1)) for k in range(1, 15)]
    counts = [rng.randrange(t) for t in totals]
    got = dv.share(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals)]
