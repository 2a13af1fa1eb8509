"""Merkle manifest against a brute-force version."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from logtab.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(one, row))


def tree(nodes, fanout):
    """Top digest, and per node the levels of (before, after)."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, merged = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at:at + fanout]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h(*run))
            merged.append([i for u in under[at:at + fanout] for i in u])
        nodes, under = up, merged
    return nodes[0], paths


def brute(rows, fanout=3):
    by_source = {}
    for r in rows:
        changed = (*r[:4], r[4].replace("\n", "") if r[4] is not None and r[0] is not None
                   and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4])
        by_source.setdefault(r[1], []).append((r[0], leaf(r), leaf(changed)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        trees.append(tree([x[1] for x in by_source[s]], fanout))
    root, upper = tree([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, paths), up in zip(order, trees, upper):
        for (i, own, candidate), path in zip(by_source[s], paths):
            acc = candidate
            for before, after in path + up:
                acc = h(before, acc, after)
            out.append((i, own, subroot, root, h(*[b + a for b, a in path + up]), acc))
    return sorted(out, key=str)


def result(docs, fanout=3):
    tampered = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    changed = F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    done = merkle.manifest(docs, changed, fanout=fanout)
    rows = done.select("id", *[merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")],
                       F.sha2(merkle.siblings(F.col("proof")), 256), merkle.hexed(F.col("folded_root"))).collect()
    return sorted([tuple(r) for r in rows], key=str)


def sample():
    rng = random.Random(2)
    rows = []
    for i in rng.sample(range(10_000), 70):
        source = rng.choice(["web"] * 8 + ["wiki", "büch", None, "", "Z"])
        text = rng.choice([None, "", "one line", "two\nlines", "é\n\nü", "x\n" * 500])
        rows.append((i, source, rng.choice(["en", None]), None if text is None else len(text), text))
    return rows + [(5, "alone", "en", 3, "a\nb"), rows[0], rows[0], (rows[1][0], rows[1][1], "fr", 1, "tie\n"),
                   (None, "web", None, None, "no\nid")]


def test_against_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(docs) == brute(rows)


def test_other_fanouts_and_one_source(spark):
    rows = [(i, "s", "en", 1, f"{i}\n") for i in range(17)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for fanout in (2, 5):
        assert result(docs, fanout) == brute(rows, fanout)


def test_single_row_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "s", "en", 1, "t\n", 7, "x", "y")], SCHEMA + ", pos int, n string, digest string")
    assert result(docs) == brute([(4, "s", "en", 1, "t\n")])
    assert result(docs.limit(0)) == []
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof == []


def test_untampered_rows_verify(spark):
    rows = [(i, "a" if i % 3 else "b", None, None, "same") for i in range(30)]
    done = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.folded_root == r.root for r in done) and len({r.root for r in done}) == 1
