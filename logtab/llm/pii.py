"""Personal data: fixed patterns, and a skip-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import byte_texts, small_batches
from logtab.llm.spans import Span, scan_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"crf_{k}" for k in BASE))
LABELS = ("none", *BASE)
L = len(LABELS)

LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a failed or finished match leaves no start within the same run of digits
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(rb"[0-9]+")
HAS_DIGIT = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in linear time: each ``@`` in turn, with all that
    can be a local part before it."""
    done, at = 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and raw[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = raw.find(b"@", max(at + 1, done))


def base_spans(raw: bytes) -> list[Span]:
    found = [(a, b, "email", 1.0) for a, b in emails(raw)] if b"@" in raw else []
    if not HAS_DIGIT.search(raw):
        return found
    found += [(m.start(), m.end(), "ip", 1.0) for m in IP.finditer(raw) if all(int(p[-4:]) <= 255 and len(p.lstrip(b"0")) <= 3 for p in m.group().split(b"."))]
    for m in CARD.finditer(raw):
        digits = b"".join(DIGITS.findall(m.group()))
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card", 1.0))
    if b"+" in raw:
        for m in PHONE.finditer(raw):
            if 10 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                found.append((m.start(), m.end(), "phone", 1.0))
    return found


# --- tokens and features -------------------------------------------------------

TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
EVIDENCE = re.compile(rb"[0-9@]")
SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"[\x80-\xff]+"), b"u"))
EDGES = b"\"'`.,;:!?()[]{}<>|"


def shape(token: bytes) -> bytes:
    for form, mark in SHAPES:
        token = form.sub(mark, token)
    return token[:24]


def features(tokens: list[bytes], i: int) -> list[bytes]:
    """Names of a token's features: its own form, and those of its
    neighbours."""
    t = tokens[i]
    core = t.strip(EDGES)
    digits = sum(map(len, DIGITS.findall(core)))
    before = tokens[i - 1] if i else b"<s>"
    after = tokens[i + 1] if i + 1 < len(tokens) else b"</s>"
    return [b"bias", b"shape=" + shape(core), b"digits=%d" % min(digits, 20), b"edge=" + shape(t[:1]) + shape(t[-1:]),
            b"at=%d" % (b"@" in core), b"before=" + shape(before), b"after=" + shape(after),
            b"word=" + before.strip(EDGES).lower()[:16], b"form=" + shape(core) + b"/%d" % min(digits, 20)]


def skip_keys(token: bytes) -> list[bytes]:
    """What makes two tokens the same or similar for a skip edge: the token
    itself but for case and punctuation around it, its digits from four on,
    and the local part of an address."""
    core = token.strip(EDGES).lower()
    keys = [b"t" + core] if len(core) > 2 else []
    digits = b"".join(DIGITS.findall(core))
    if len(digits) >= 4:
        keys.append(b"d" + digits)
    local = core.partition(b"@")[0]
    if b"@" in core and len(local) > 2:
        keys.append(b"l" + local)
    return keys


@dataclass
class Graph:
    """The part of a document's field that is not settled: tokens with some
    evidence.  All others are clamped to ``none``, which cuts the chain."""

    tokens: list[bytes]
    starts: list[int]
    ends: list[int]
    free: list[int]
    chain: np.ndarray  # pairs of places in ``free`` that are neighbours
    skip: np.ndarray  # pairs of places in ``free`` that repeat one another, each with the one before
    hubs: list[tuple[list[int], bool]]  # places that share a key, and whether the key tells much


# What a number in several tokens consists of.
PIECE = re.compile(rb"[0-9().+,;:-]+")
JOINED = range(7, 20)


def strong(key: bytes) -> bool:
    """Whether tokens hardly share the key by chance: an address, its local
    part, or as many digits as a number that is called."""
    return b"@" in key or key[:1] == b"l" or sum(map(len, DIGITS.findall(key))) >= JOINED[0]


def token_keys(tokens: list[bytes], spans: list[tuple[int, int]], free: list[int], found: list[Span]) -> list[list[bytes]]:
    """Skip keys of the free tokens: their own, and the joined digits of the
    fixed span, or of the run of bare pieces, that they are part of."""
    keys = [skip_keys(tokens[i]) for i in free]

    def join(places: list[int]) -> None:
        digits = b"".join(d for k in places for d in DIGITS.findall(tokens[free[k]]))
        for k in places if len(digits) in JOINED else ():
            if b"d" + digits not in keys[k]:
                keys[k].append(b"d" + digits)

    at = 0
    for a, b, kind, _ in sorted(found):
        while at < len(free) and spans[free[at]][1] <= a:
            at += 1
        if kind != "email":
            inside = at
            while inside < len(free) and spans[free[inside]][0] < b:
                inside += 1
            join(list(range(at, inside)))
    run: list[int] = []
    for k, i in enumerate([*free, -1]):
        bare = i >= 0 and PIECE.fullmatch(tokens[i]) is not None
        if run and not (bare and i == free[run[-1]] + 1):
            if len(run) > 1:
                join(run)
            run = []
        if bare:
            run.append(k)
    return keys


def graph(raw: bytes, found: list[Span] = ()) -> Graph | None:
    if not EVIDENCE.search(raw):
        return None
    spans = [m.span() for m in TOKEN.finditer(raw)]
    tokens = [raw[a:b] for a, b in spans]
    free = [i for i, t in enumerate(tokens) if EVIDENCE.search(t)]
    chain, skip = [], []
    members: dict[bytes, list[int]] = {}
    for k, (i, keys) in enumerate(zip(free, token_keys(tokens, spans, free, list(found)))):
        if k and free[k - 1] == i - 1:
            chain.append((k - 1, k))
        linked = set()
        for key in keys:
            before = members.setdefault(key, [])
            if before and before[-1] not in linked:
                skip.append((before[-1], k))
                linked.add(before[-1])
            before.append(k)
    hubs: dict[tuple[int, ...], bool] = {}
    for key, places in members.items():  # keys of the same tokens make one hub
        if len(places) > 1:
            hubs[tuple(places)] = hubs.get(tuple(places), False) or strong(key)
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    return Graph(tokens, [s[0] for s in spans], [s[1] for s in spans], free, *pairs, [(list(p), s) for p, s in hubs.items()])


def silver_labels(g: Graph, spans: list[Span]) -> list[int]:
    """Label of each free token: the kind of the fixed span that holds it."""
    spans, out, at = sorted(spans), [], 0
    for i in g.free:
        a, b = g.starts[i], g.ends[i]
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        out.append(LABELS.index(spans[at][2]) if at < len(spans) and spans[at][0] < b else 0)
    return out


def doubtful(labels: list[int], skip: np.ndarray) -> list[int]:
    """Labels for training: -1 for tokens without a label that repeat a
    labelled one (directly or over others).  The patterns missed them or they
    are no personal data, and telling which is what the field is for."""
    out = list(labels)
    for pairs in (skip.tolist(), skip.tolist()[::-1]):
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if out[x] and not out[y]:
                    out[y] = -1
    return out


# Pull of a skip edge whose tokens hardly share the key by chance, and the most
# that is learned for one whose tokens may.
STRONG_SKIP, WEAK_SKIP = 8.0, 4.0


# --- the model -------------------------------------------------------------------

@dataclass
class Model:
    """Log-linear weights per feature and label, and pair potentials."""

    weights: dict[bytes, np.ndarray]
    chain: np.ndarray
    skip: float

    def unary(self, g: Graph) -> np.ndarray:
        out = np.zeros((len(g.free), L))
        for k, i in enumerate(g.free):
            for f in features(g.tokens, i):
                w = self.weights.get(f)
                if w is not None:
                    out[k] += w
        return out


def logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=-1, keepdims=True)))[..., 0]


def marginals(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, chain_pair: np.ndarray, skip_weight: float | np.ndarray,
              share: np.ndarray | None = None, rounds: int = 200, damping: float = 0.3, tolerance: float = 1e-4) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product message
    passing over chain and skip edges (exact where these form a forest).
    ``skip_weight`` is one for all skip edges or one for each; ``share``
    tempers what the first end of each skip edge tells the second.  Hubs keep
    every repeat two steps from the others, so ``rounds`` bounds what
    neighbours along the chain tell one another, not how far repeats reach."""
    nodes, edges = len(unary), np.concatenate([chain, skip])
    if not len(edges):
        return np.exp(unary - logsumexp(unary)[:, None])
    same = np.broadcast_to(skip_weight, len(skip))[:, None, None] * np.eye(L)
    pair = np.concatenate([np.broadcast_to(chain_pair, (len(chain), L, L)), same])
    part = np.ones(2 * len(edges))
    if share is not None:
        part[len(chain):len(edges)] = share
    # messages both ways: the first half runs along each edge, the second back
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), L))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = logsumexp((belief[src] - msg[back])[:, None, :] + pair.transpose(0, 2, 1)) * part[:, None]
        out -= logsumexp(out)[:, None]
        moved = np.abs(out - msg).max()
        msg = damping * msg + (1 - damping) * out
        if moved < tolerance:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    return np.exp(belief - logsumexp(belief)[:, None])


def train(examples: list[tuple[list[list[bytes]], list[int], list[tuple[int, int]], list[tuple[int, int]]]],
          epochs: int = 60, rate: float = 0.5, decay: float = 1e-3, min_count: int = 2) -> Model:
    """Weights from labelled documents: features, labels (-1: unknown), chain
    pairs, skip pairs.  The feature weights are fitted by logistic regression (full
    gradient, so the result does not depend on an order); pair potentials
    are smoothed log ratios of how often labels meet on an edge to how often
    they would by chance."""
    count: dict[bytes, int] = {}
    for feats, *_ in examples:
        for fs in feats:
            for f in fs:
                count[f] = count.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= min_count))}
    rows, cols, y = [], [], []
    for feats, labels, *_ in examples:
        for fs, label in zip(feats, labels):
            if label < 0:
                continue
            known = [index[f] for f in fs if f in index]
            rows += [len(y)] * len(known)
            cols += known
            y.append(label)
    share = np.bincount(np.array(y, int), minlength=L) + 1.0 if y else np.ones(L)
    share /= share.sum()
    meet, skips = np.full((L, L), 0.5), np.array([1.0, 1.0])
    for _, labels, chain, skip in examples:
        for a, b in chain:
            if labels[a] >= 0 and labels[b] >= 0:
                meet[labels[a], labels[b]] += 1
        for a, b in skip:
            if labels[a] >= 0 and labels[b] >= 0:
                skips[int(labels[a] == labels[b])] += 1
    agree = float((share ** 2).sum())
    skip_weight = float(np.clip(np.log(skips[1] / skips[0]) - np.log(agree / max(1 - agree, 1e-9)), 0.5, WEAK_SKIP))
    pair = np.clip(np.log(meet / meet.sum()) - np.log(meet.sum(1, keepdims=True) / meet.sum()) - np.log(meet.sum(0) / meet.sum()), -4, 4)
    w = np.zeros((len(index), L))
    if y:
        rows_a, cols_a, target = np.array(rows), np.array(cols), np.eye(L)[np.array(y)]
        speed = np.full((len(index), L), 1e-8)
        for _ in range(epochs):
            score = np.zeros((len(y), L))
            np.add.at(score, rows_a, w[cols_a])
            wrong = np.exp(score - logsumexp(score)[:, None]) - target
            grad = decay * len(y) * w
            np.add.at(grad, cols_a, wrong[rows_a])
            speed += grad ** 2
            w -= rate * grad / np.sqrt(speed)
    w = np.round(w, 6)
    return Model({f: w[i] for f, i in index.items()}, np.round(pair, 6), round(skip_weight, 6))


def labelled(g: Graph, model: Model, settled: list[int]) -> np.ndarray:
    """Label probabilities of the free tokens.

    All tokens that share a key meet in one hub, a node without evidence of
    its own, so a repeat lies two steps from every other however many there
    are.  Both steps together weigh as much as one skip edge between two
    tokens.  Settled tokens tell their hub all they know; the others, which
    mostly repeat one and the same evidence, tell it their mean.
    """
    unary = np.concatenate([model.unary(g), np.zeros((len(g.hubs), L))])
    for k, label in enumerate(settled):
        if label:  # fixed spans are settled and speak for their repeats
            unary[k] = np.where(np.arange(L) == label, 0.0, -30.0)
    skip, weight, share = [], [], []
    for h, (places, tells) in enumerate(g.hubs):
        open_ = sum(not settled[k] for k in places)
        pull = STRONG_SKIP if tells else min(model.skip, WEAK_SKIP)
        skip += [(k, len(g.free) + h) for k in places]
        weight += [pull + np.log(2.0)] * len(places)
        share += [1.0 if settled[k] else 1.0 / open_ for k in places]
    edges = np.array(skip, np.int64).reshape(-1, 2)
    return marginals(unary, g.chain, edges, model.chain, np.array(weight), np.array(share))[:len(g.free)]


def scan(raw: bytes, model: Model, confidence: float) -> list[Span]:
    """Fixed spans, and runs of tokens that the field labels alike with at
    least ``confidence`` and that touch no fixed span."""
    found = base_spans(raw)
    g = graph(raw, found)
    if g is None:
        return found
    p = labelled(g, model, silver_labels(g, found))
    best = p.argmax(axis=1)
    taken, out, at = sorted(found), [], 0
    for k, i in enumerate(g.free):
        a, b = g.starts[i], g.ends[i]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not best[k] or p[k, best[k]] < confidence or (at < len(taken) and taken[at][0] < b):
            continue
        core = g.tokens[i].strip(EDGES)
        start = a + g.tokens[i].find(core)
        kind, score = f"crf_{LABELS[best[k]]}", round(float(p[k, best[k]]), 6)
        if out and out[-1][2] == kind and out[-1][4] == i - 1:
            out[-1] = (out[-1][0], start + len(core), kind, min(score, out[-1][3]), i)
        elif core:
            out.append((start, start + len(core), kind, score, i))
    return found + [s[:4] for s in out]


# --- the operator -----------------------------------------------------------------

FIT_DOCS = 2000
FIT_TOKENS = 400
CONFIDENCE = 0.95


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_tokens: int = FIT_TOKENS) -> Model:
    """Train on a bounded sample: the ``fit_docs`` rows with ``@`` or a digit
    whose ids hash lowest, the first ``fit_tokens`` tokens with evidence of
    each.  The labels are the fixed patterns' spans.  Only the features of
    these tokens reach the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9@]"))
    lot = F.xxhash64(F.lit(7), F.col("id"))
    chosen = rows.select("id", lot.alias("lot")).distinct().orderBy("lot", "id").limit(fit_docs)
    schema = "id long, feats array<array<binary>>, labels array<int>, chain array<array<int>>, skip array<array<int>>"

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                spans = base_spans(raw)
                g = graph(raw, spans)
                if g is None:
                    continue
                labels = doubtful(silver_labels(g, spans), g.skip)[:fit_tokens]
                pairs = [[p for p in e.tolist() if max(p) < fit_tokens] for e in (g.chain, g.skip)]
                out.append((doc, [features(g.tokens, i) for i in g.free[:fit_tokens]], labels, *pairs))
            columns = list(zip(*out)) if out else [()] * 5
            pairs = pa.list_(pa.list_(pa.int32()))
            types = [pa.int64(), pa.list_(pa.list_(pa.binary())), pa.list_(pa.int32()), pairs, pairs]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "feats", "labels", "chain", "skip"])

    # the chosen ids number at most ``fit_docs``
    found = rows.join(F.broadcast(chosen.select("id")), "id", "left_semi").mapInArrow(examples, schema)
    sample = found.orderBy(F.xxhash64(F.lit(7), F.col("id")), "id").limit(fit_docs).collect()
    return train([([[bytes(f) for f in fs] for fs in r.feats], list(r.labels), list(r.chain), list(r.skip)) for r in sample])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None,
                       confidence: float = CONFIDENCE) -> DataFrame:
    """``(id, spans)`` for every row of ``docs``; a span is (start, end, kind,
    score) in code points.

    ``email``, ``ip``, ``card`` and ``phone`` are the fixed patterns,
    leftmost and non-overlapping per kind over the whole text.  ``crf_...``
    spans are tokens that a skip-chain conditional random field labels with
    at least ``confidence``: neighbouring tokens and tokens that repeat one
    another (however far apart, and also where a number is written in groups
    in one place and in one piece in another) share potentials, and message
    passing over each document makes the labels agree, so bare repeats of a
    found number are found as well, be it one or hundreds.  Repeats of a
    number that nothing found do not count as evidence for one another beyond
    their mean.  Tokens without a digit or ``@`` are taken as settled.

    The model is trained here on a bounded sample (``fit``) unless given.
    Null and empty texts have no spans; rows that repeat are scanned as often
    as they occur; an empty table has no rows; other columns do not matter.
    No shuffle of texts.
    """
    model = model or fit(docs, id_col, text_col)
    return scan_texts(docs, id_col, text_col, lambda raw: scan(raw, model, confidence), KINDS)
