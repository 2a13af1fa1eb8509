"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import byte_texts, materialise, settled, small_batches, without
from logtab.llm.components import components

SHINGLE = 3
MAX_BITS = 3
BLOCKS = 6
GROUP_ROWS = 4096
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text as a signed number.

    Words of the A-Z lower-cased text (``bytes.lower`` touches nothing else)
    form shingles of ``shingle`` words, repeats included; fewer words make
    one shingle of them all, no word gives zero.  A bit is set when more
    than half of the shingles' XXH64 values (seed 42) have it.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1:]
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = [fingerprint(t, shingle) for t in byte_texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """Array of (choice of blocks, their bits): two fingerprints within
    ``max_bits`` agree on at least ``blocks - max_bits`` whole blocks, so
    they share the entry of some such choice."""
    if not max_bits < blocks <= 64:
        raise ValueError(f"blocks must lie in {max_bits + 1}..64")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    keys = []
    for i, chosen in enumerate(combinations(masks, blocks - max_bits)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(i).alias("choice"),
                             fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that span each component of the link graph of one block group:
    every reached fingerprint is compared with those not yet reached."""
    rest, queue, edges = np.arange(1, len(fps)), [0], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        i = queue.pop()
        near = np.bitwise_count(fps[rest] ^ fps[i]) <= max_bits
        for j in rest[near].tolist():
            edges.append((i, j))
            queue.append(j)
        rest = rest[~near]
    return edges


def link_groups(batches: Iterator[pa.RecordBatch], max_bits: int, group_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (choice, bits, fp, rep) sorted by choice and bits in; spanning
    links ``(a, b)`` of each group out.  A group beyond ``group_rows`` is not
    held: its rows go out as ``(rep, null, fp)`` to be split further."""
    held: list[np.ndarray] = []  # 4-column pieces of the group that is still open
    count, spilling = 0, None  # spilling: key of a group whose rows go straight out

    def out(a, b, fp) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(fp, pa.int64())], names=["a", "b", "fp"])

    def overflow(rows: np.ndarray) -> pa.RecordBatch:
        return out(rows[:, 3], [None] * len(rows), rows[:, 2])

    def links(rows: np.ndarray, a: list, b: list) -> None:
        for i, j in forest(rows[:, 2].astype(np.uint64), max_bits):
            a.append(int(rows[i, 3]))
            b.append(int(rows[j, 3]))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c.cast(pa.int64())) for c in batch.columns], axis=1)
        cut = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
        a: list[int] = []
        b: list[int] = []
        for s, e in zip(starts.tolist(), ends.tolist()):
            key, last = (rows[s, 0], rows[s, 1]), e == len(rows)
            if spilling is not None:
                if spilling == key:
                    yield overflow(rows[s:e])
                    continue
                spilling = None
            if held and (held[0][0, 0], held[0][0, 1]) != key:
                if count > 1:
                    links(np.concatenate(held), a, b)
                held, count = [], 0
            if held or last:
                held.append(rows[s:e])
                count += e - s
                if count > group_rows:
                    yield overflow(np.concatenate(held))
                    held, count, spilling = [], 0, key
                elif not last:
                    links(np.concatenate(held), a, b)
                    held, count = [], 0
            elif e - s > group_rows:
                yield overflow(rows[s:e])
            elif e - s > 1:
                links(rows[s:e], a, b)
        if a:
            yield out(a, b, [None] * len(a))
    if count > 1:
        a, b = [], []
        links(np.concatenate(held), a, b)
        if a:
            yield out(a, b, [None] * len(a))


def block_links(reps: DataFrame, blocks: int, max_bits: int, group_rows: int) -> DataFrame:
    """Output of ``link_groups`` over distinct ``(fp, rep)`` rows."""
    keyed = reps.select("fp", "rep", F.explode(block_keys(F.col("fp"), blocks, max_bits)).alias("key"))
    dealt = (keyed.select(F.col("key.choice").alias("choice"), F.col("key.bits").alias("bits"), "fp", "rep")
             .repartition("choice", "bits").sortWithinPartitions("choice", "bits"))
    return dealt.mapInArrow(lambda it: link_groups(it, max_bits, group_rows), "a long, b long, fp long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits;
    ``component_id`` is the smallest id reachable by links, the row's own
    included.  Equal fingerprints are folded first, so exact copies add no
    candidates.  Every distinct fingerprint is then dealt to the groups of
    all choices of ``blocks - max_bits`` blocks and each group yields only
    links that span its components, never all its pairs.  With the default
    six blocks a group shares at least 31 bits; raise ``blocks`` with the
    corpus (n documents meet in about n^2 / 2^(64 * (1 - max_bits / blocks))
    chance pairs per choice).  A group of more than ``group_rows``
    fingerprints is dealt again by 16 blocks of four bits, where no group
    can pass ``2^(4 * max_bits)`` members.

    Null texts count as empty; all wordless rows have fingerprint zero and
    link like any others.  Rows with a null id get the component of the rows
    sharing their fingerprint (null if there is none) and link nothing
    themselves.  An id that repeats keeps one output row per input row, and
    links all the rows that carry it only through their fingerprints.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    reps = materialise(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    found = materialise(block_links(reps, blocks, max_bits, group_rows), "simhash-links")
    links = found.where("b is not null").select("a", "b")
    rest = found.where("b is null").select("fp", F.col("a").alias("rep"))
    if not rest.isEmpty():
        fine = block_links(rest.distinct(), 16, max_bits, 1 << (4 * max_bits))
        links = links.union(fine.select("a", "b"))
    group = components(links)
    # materialised so that the join below reads a plain table on each side and a hot fingerprint can be split
    classes = materialise(
        reps.join(group, reps.rep == group.node, "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-classes")
    return fps.join(classes, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their near-duplicate
    group (all columns, unchanged).  Rows with a null id stay."""
    def repeats() -> DataFrame:
        groups = simhash_groups(docs, id_col, text_col, **options)
        gone = groups.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).cast("long").alias("id"))
        return materialise(gone.distinct(), "simhash-gone")

    return without(docs, lambda c: [c(id_col).cast("long")], settled(repeats))
