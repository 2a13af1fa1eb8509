"""The pipeline's stages against brute-force versions, one after another."""

import os
import random
import re

import test_linededup
import test_simhash
from pyspark.sql import functions as F

import corpus_pipeline
from logtab.llm import mixing, packing, quality
from logtab.llm.linededup import row_key

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(500)]
    line = lambda: " ".join(rng.choices(vocab, k=9)).capitalize() + "."
    shared = [line() for _ in range(4)]
    texts = []
    for _ in range(70):
        lines = [line() for _ in range(rng.randrange(6, 12))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared))
        if rng.random() < 0.2:
            lines.append(lines[0][:-1] + "x.")
        texts.append("\n".join(lines))
    # near copies in one long line each, so that line dedup leaves them
    base = rng.choices(vocab, k=300)
    texts += [" ".join([*base[:i * 40], "other", *base[i * 40 + 1:]]) for i in range(6)]
    texts += [texts[3], texts[4], "few words", None, "", "same words here " * 40, shared[0]]
    return [(1000 - i if i != 20 else None, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, tmp_dir, monkeypatch):
    sf_dir = os.path.join(tmp_dir, "sf")
    docs = spark.createDataFrame(make_docs(), COLUMNS)
    docs.repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    frames = []  # what each stage was given

    def noted(stage):
        return lambda spark, docs, sf_dir: frames.append(docs) or stage(spark, docs, sf_dir)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(f)) for n, f in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, sf_dir)
    assert len(frames) == 5 and all(f.columns == docs.columns for f in frames)
    start, good, lines, single, mixed = frames

    kept = {(r.id, r.key) for r in quality.judged(start).collect() if r.kept}
    keyed = start.withColumn("k", row_key(F.col("text"))).collect()
    assert rows_of(good) == sorted((tuple(r)[:5] for r in keyed if (r.doc_id, r.k) in kept), key=repr)
    assert 0 < good.count() < start.count()

    keyed = good.withColumn("k", row_key(F.col("text"))).collect()
    brute = {(r[0], r[1]): r for r in test_linededup.brute([(r.doc_id, r.k, r.text) for r in keyed])}
    want = [(i, t, len(t) if n + m else None) for (i, t), (_, _, _, n, m, _) in brute.items() if not (n + m) or re.search(r"[^\x20\x09-\x0D]", t)]
    got = {(r.doc_id, r.text): r.n_chars for r in lines.collect()}
    assert got.keys() == {w[:2] for w in want} and all(c is None or got[i, t] == c for i, t, c in want)
    assert 0 < lines.count() < good.count()

    groups = test_simhash.brute([(r.doc_id, r.text) for r in lines.collect() if r.doc_id is not None])
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c} | {None}
    assert single.count() < lines.count()

    profile = mixing.profile(single)
    drawn = {(r.id, r.key) for r in mixing.mixed(profile).collect() if r.kept}
    keyed = single.withColumn("k", row_key(F.col("text"))).collect()
    assert rows_of(mixed) == sorted((tuple(r)[:5] for r in keyed if (r.doc_id, r.k) in drawn), key=repr)

    sizes = {r.doc_id: len((r.text or "").split()) for r in mixed.collect()}
    source = {r.doc_id: r.source for r in mixed.collect()}
    assert {r.doc_id: r.length for r in packed.collect()} == sizes  # all shorter than a bin
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.bin, []).append(r)
    for held in bins.values():
        assert sum(r.length for r in held) <= packing.CAPACITY
        named = [source[r.doc_id] for r in held if source[r.doc_id] is not None]
        assert len(named) == len(set(named))


def test_empty_documents(spark, tmp_dir):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0
