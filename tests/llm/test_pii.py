"""Personal-data scan against the patterns as stated, and exact inference."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from logtab.llm import pii
from logtab.llm.spans import digest, to_code_points

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and brute_luhn(d):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [o[2] for o in sorted(out)]


def make_texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "1", "23", "255", "256", "0001", "+", "(", ")", "+1 (017) 555-7713", "4929348385146306",
             "é", "\n", "_", "10.0.0.1", "4111 1111 1111 1111", "%"]
    texts = ["", None, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "00000000255.1.1.1", "call +1 (017) 555-7713 or éé 4929-3483-8514-6306.", "9" * 30_000,
             "a" * 30_000 + "@", "+1" + " " * 20_000, "@@@a@@b.c"]
    return texts + ["".join(rng.choices(parts, k=25)) for _ in range(500)]


def test_base_spans():
    for t in make_texts():
        raw = (t or "").encode()
        mine = sorted((a, pii.KINDS.index(k), f"{k}:{a}:{b}") for a, b, k, _ in to_code_points(raw, pii.base_spans(raw)))
        assert [m[2] for m in mine] == brute_base(t or ""), t


def exact(unary, chain, skip, pair, weight):
    n = len(unary)
    total = np.zeros((n, pii.L))
    for labels in itertools.product(range(pii.L), repeat=n):
        s = sum(unary[i, x] for i, x in enumerate(labels))
        s += sum(pair[labels[a], labels[b]] for a, b in chain) + sum(weight * (labels[a] == labels[b]) for a, b in skip)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing():
    rng = np.random.default_rng(2)
    pair = rng.normal(size=(pii.L, pii.L))
    none = np.zeros((0, 2), int)
    for chain, skip, close in (([(0, 1), (1, 2)], none, 1e-3), (none, none, 1e-9), ([(0, 1), (2, 3)], [(1, 3)], 1e-3), ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.06)):
        unary = rng.normal(size=(4, pii.L))
        got = pii.marginals(unary, np.array(chain), np.array(skip), pair * 0.5, 1.0, rounds=200, tolerance=1e-9)
        assert np.abs(got - exact(unary, chain, skip, pair * 0.5, 1.0)).max() < close


def make_docs():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)]
        tail = f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        if i % 2:
            words[5:5] = [f"+1 ({rng.randrange(100, 999)})", tail]
            words[20:20] = [str(rng.randrange(10_000))]
        if i % 3 == 0:
            words[8:8] = [f"user{i}@mail.example.com"]
        if i % 8 == 1:
            words[25:25] = [tail]  # the number again, without what the pattern needs
        rows.append((i, " ".join(words)))
    return rows


def test_field_finds_repeats(spark):
    rows = make_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in digest(pii.find_personal_data(df), "doc_id", pii.BASE).collect()}
    repeats = [i for i, _ in rows if i % 8 == 1]
    assert sum("crf_phone" in got[i].spans for i in repeats) > 0.9 * len(repeats)
    others = [i for i, _ in rows if i % 8 != 1]
    assert sum(got[i].n_added > 0 for i in others) < 0.02 * len(others)
    for i, t in rows:
        want = brute_base(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("crf")] == want
    again = pii.fit(df.repartition(7))
    model = pii.fit(df)
    assert again.skip == model.skip and again.weights.keys() == model.weights.keys()
    assert all(np.array_equal(again.weights[k], model.weights[k]) for k in model.weights)


@pytest.fixture(scope="module")
def real_model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


FILLER = " and then we went on to speak of other things for a while "


@pytest.mark.parametrize("times", [1, 3, 10, 40, 100])
def test_every_bare_repeat_is_found(real_model, times):
    raw = ("Call +493012345678 today." + (FILLER + "493012345678") * times + FILLER).encode()
    kinds = [k for *_, k, _ in pii.scan(raw, real_model, pii.CONFIDENCE)]
    assert kinds.count("phone") == 1 and kinds.count("crf_phone") == times


def test_numbers_in_groups_and_in_one_piece(real_model):
    for first, again in (("+1 (415) 555-2671", "14155552671"), ("+1 (415) 555-2671", "1 415 555 2671")):
        raw = f"Call {first} today.{FILLER}{again}{FILLER}".encode()
        found = pii.scan(raw, real_model, pii.CONFIDENCE)
        at = raw.index(again.encode(), 30)
        assert any(k == "crf_phone" and a <= at and b >= at + len(again) for a, b, k, _ in found), (again, found)


@pytest.mark.parametrize("times", [1, 3, 10, 40])
def test_unrelated_repeats_are_no_evidence(real_model, times):
    """A number that no pattern accepts does not become one by repeating."""
    raw = (("The part 4929348385146307" + FILLER) * times).encode()
    assert pii.scan(raw, real_model, pii.CONFIDENCE) == []


def test_hubs_are_linear():
    g = pii.graph(b" ".join([b"x 493012345678"] * 5000))
    assert len(g.hubs) == 1 and len(g.hubs[0][0]) == 5000 and len(g.skip) == 4999


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, "a@b.co", 1), (1, None, 2), (1, "", 3), (2, "a@b.co", 4), (2, "a@b.co", 4)], "doc_id long, text string, spans int")
    out = digest(pii.find_personal_data(df), "doc_id", pii.BASE)
    assert sorted((r.doc_id or 0, r.n_email) for r in out.collect()) == [(0, 1), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert digest(pii.find_personal_data(df.limit(0)), "doc_id", pii.BASE).count() == 0
