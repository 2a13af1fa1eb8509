"""Embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtab.llm.common import materialise
from logtab.llm.components import components

THRESHOLD = 0.9
TILE = 4096
ROWS = 512  # rows of a tile multiplied at once
EXACT_DIMS = 1024  # 127 * 127 * 1024 < 2^24: sums of so many products are exact in float32
SLACK = 1e-9  # far above the rounding of the bounds themselves
DEGREE, EDGE, UNSURE = 0, 1, 2


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine(x: pa.Scalar, y: pa.Scalar) -> float:
    """Cosine of two vectors of equal length in double precision."""
    x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors to int8: codes, scales, norms of the coded vectors and
    norms of the errors (what coding lost), all in double precision."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows, by float32 multiplication over
    blocks of dimensions."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_DIMS):
        total += a[:, i:i + EXACT_DIMS].astype(np.float32) @ b[:, i:i + EXACT_DIMS].astype(np.float32).T
    return total


def link_tiles(rows: pa.Table, threshold: float) -> pa.Table:
    """All links between the two tiles of one group (or within the one).

    The cosine of two unit vectors differs from the product of their codes
    by at most ``|x'||f| + |e||y'| + |e||f|`` (codes ``x'``, ``y'``, errors
    ``e``, ``f``).  Pairs below the threshold by more than that are out,
    pairs above it by more are links, and only the rest go out as unsure.
    Links go out as each vector's number of linked vectors and as edges that
    span their components, so a dense tile emits no more rows than it holds.
    """
    ids, size = (rows[c].to_numpy() for c in ("rep", "n"))
    scale, norm, err = (rows[c].to_numpy() for c in ("scale", "norm", "err"))
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.int8).reshape(len(ids), -1)
    tile, own = rows["tile"].to_numpy(), rows["ti"][0].as_py()
    left = np.flatnonzero(tile == own)
    right = left if rows["ti"][0].as_py() == rows["tj"][0].as_py() else np.flatnonzero(tile != own)
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    unsure: list[np.ndarray] = []
    if len(left) and len(right):
        for s in range(0, len(left), ROWS):
            block = left[s:s + ROWS]
            dots = products(codes[block], codes[right])
            # a bound for the whole row first, then pair by pair
            slack = norm[block] * err[right].max() + err[block] * (norm[right] + err[right]).max() + SLACK
            least = threshold - slack
            least /= scale[block] * np.where(least > 0, scale[right].max(), scale[right].min())
            at, to = np.nonzero(dots >= least[:, None])
            x, y = block[at], right[to]
            if right is left:
                x, y, at, to = x[x < y], y[x < y], at[x < y], to[x < y]
            near = dots[at, to].astype(np.float64) * scale[x] * scale[y]
            bound = norm[x] * err[y] + err[x] * norm[y] + err[x] * err[y] + SLACK
            sure = near - bound >= threshold
            maybe = ~sure & (near + bound >= threshold)
            unsure.append(np.stack([x[maybe], y[maybe]]))
            x, y = x[sure], y[sure]
            np.add.at(links, x, size[y])
            np.add.at(links, y, size[x])
            span(label, x, y)
    some = np.flatnonzero(links)
    joined = np.flatnonzero(label != np.arange(len(ids)))
    u = np.concatenate(unsure, axis=1) if unsure else np.zeros((2, 0), int)
    return pa.table({
        "kind": pa.array(np.repeat([DEGREE, EDGE, UNSURE], [len(some), len(joined), u.shape[1]]), pa.int32()),
        "a": pa.array(np.concatenate([ids[some], ids[joined], ids[u[0]]]), pa.int64()),
        "b": pa.array(np.concatenate([ids[some], ids[label[joined]], ids[u[1]]]), pa.int64()),
        "links": pa.array(np.concatenate([links[some], np.zeros(len(joined) + u.shape[1], np.int64)]), pa.int64())})


def span(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Lower ``label`` in place to the smallest index of each component:
    roots are hooked onto smaller roots, then all pointers are followed; a
    hook that another one overwrote is tried again in the next round."""
    while True:
        left, right = label[x], label[y]
        differ = left != right
        if not differ.any():
            return
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(left, right)[differ], np.minimum(left, right)[differ])
        while not np.array_equal(label, label[label]):
            label[:] = label[label]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                 tile: int = TILE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``.

    Two rows are linked if the cosine of their vectors, in double precision,
    is ``threshold`` or more; ``n_links`` counts the other rows linked
    directly, ``component_id`` is the smallest id reachable, ``kept`` marks
    the row that has it.  Every pair is compared: equal vectors are folded
    first, the others are dealt by hash to tiles of about ``tile`` and every
    two tiles meet once, as int8 codes.  Only pairs that the codes cannot
    decide are fetched and computed in full precision.

    Vectors that are null, empty or zero, or hold a null or a non-finite
    component, link with nothing (0 links, their own component).  Vectors of
    different lengths do not link.  A row with a null id counts in others'
    ``n_links`` and is never the component's id; its own component is the
    group's smallest id, if any.  Repeated ids are separate vectors.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    values = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), values.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    # 0.0 + turns -0.0 into 0.0, so that equal vectors have equal bits
    rows = rows.withColumn("v", F.when(valid, F.transform("v", lambda c: c + F.lit(0.0))))
    hashed = rows.select("id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"),
                         F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"), "v")
    members = materialise(hashed.select("id", "h1", "h2"), "vec-members")
    reps = hashed.where("v is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "vec-reps")
    tiles = max(1, -(-reps.count() // tile))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "n", "dim", "codes", "scale", "norm", "err"]
        for b in batches:
            dims = b.column(2).value_lengths()
            for dim in dims.unique():
                part = b.filter(pc.equal(dims, dim))
                x = matrix(part.column(2))
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                codes, scale, norm, err = quantise(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([x.shape[1]] * len(x), pa.int32()),
                                       pa.array([c.tobytes() for c in codes], pa.binary()),
                                       pa.array(scale), pa.array(norm), pa.array(err)], names=names)

    coded = reps.select("rep", "n", "v").mapInArrow(
        encode, "rep long, n long, dim int, codes binary, scale double, norm double, err double")
    dealt = coded.withColumn("tile", F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")).select(
        "rep", "n", "dim", "codes", "scale", "norm", "err", "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"))
    every = met.groupBy("dim", "ti", "tj").applyInArrow(lambda t: link_tiles(t, threshold), "kind int, a long, b long, links long")
    every = materialise(every, "vec-links")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cos = np.array([cosine(x, y) for x, y in zip(b.column(4), b.column(5))])
                yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(cos >= threshold))

    unsure = every.where(F.col("kind") == UNSURE).select("a", "b")
    sides = [reps.select(F.col("rep").alias(e), F.col("n").alias("n" + e), F.col("v").alias("v" + e)) for e in "ab"]
    pairs = unsure.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "va", "vb")
    checked = materialise(pairs.mapInArrow(compare, "a long, b long, na long, nb long"), "vec-checked")
    degrees = every.where(F.col("kind") == DEGREE).select(F.col("a").alias("rep"), "links").union(
        checked.select("a", "nb")).union(checked.select("b", "na")).groupBy("rep").agg(F.sum("links").alias("links"))
    edges = every.where(F.col("kind") == EDGE).select("a", "b").union(checked.select("a", "b"))
    group = components(edges)
    named = reps.select("rep", "first", "h1", "h2", "n").join(group, F.col("rep") == F.col("node"), "left").drop("node")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialise(
        named.join(smallest, "component").join(degrees, "rep", "left").select(
            "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vec-classes")
    alone = members.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = members.where("h1 is not null").join(classes, ["h1", "h2"]).select("id", "n_links", "component_id")
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
